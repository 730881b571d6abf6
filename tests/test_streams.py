"""Streams over several micro-batches give what the batch operators give."""

from collections import Counter
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowmill.operators import lifecycle, limits, stats
from rowmill.sources import delimited, files
from rowmill.streaming import batch_log, counters, ingest, stateful


def parts(spark, folder, df, order, n=3):
    """Files that arrive one after the other, in time order."""
    rows = [tuple(r) for r in df.orderBy(order).collect()]
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return ingest.watch_parquet(spark, f"{folder}/in", df.schema, max_files=1)


def arrive(spark, folder, start, *batches, schema):
    """Run the stream after every batch of rows; the rows that each run adds, and the last run's progress."""
    added, before = [], 0
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = start(ingest.watch_parquet(spark, f"{folder}/in", spark.createDataFrame([], schema).schema))
        query = counters.append_to(out, f"{folder}/out", f"{folder}/cp")
        query.awaitTermination()
        found = [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()]
        added.append(found)
    fresh = [Counter(found) - Counter(added[i - 1] if i else []) for i, found in enumerate(added)]
    return [sorted(f.elements(), key=repr) for f in fresh], query


SECOND = 1000
DUE = "id string, created_at timestamp, scheduled_at timestamp, cancelled boolean"


def at(seconds):
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC)


def test_actions_wait_for_the_clock(spark, folder):
    def rows(*given):
        return [(name, at(seen), at(due), cancelled) for name, seen, due, cancelled in given]

    added, _ = arrive(
        spark,
        folder,
        lambda s: stateful.due_stream(s, withdrawn=F.col("cancelled")),
        rows(("past", 100, 50, None), ("soon", 100, 150, False), ("later", 100, 5000, None), ("never", 100, None, None), (None, 100, 120, None)),
        # "later" is brought forward, "gone" is cancelled in the next part, "no clock" has no time of its own.
        rows(("later", 160, 300, None), ("gone", 160, 350, None), ("no clock", None, 170, None)),
        # An older row of "later" changes nothing; an unscheduled row moves the clock.
        rows(("gone", 200, None, True), ("later", 90, 400, None), ("tick", 400, None, None)),
        rows(("due at once", 390, 380, None), ("half", 500, 400.0005, None), ("tick", 600, None, None)),
        rows(("end", 700, 10_000, None)),
        schema=DUE,
    )
    released = [{(name, due // SECOND) for name, due, _ in run} for run in added]
    assert released == [{("past", 50)}, {("soon", 150)}, {("later", 300)}, {("due at once", 380), ("half", 400)}, set()]
    for run in added:
        assert all(clock >= due for _, due, clock in run)


def test_state_of_actions_is_forgotten(spark, folder):
    _, query = arrive(
        spark,
        folder,
        lambda s: stateful.due_stream(s, keep_ms=10 * SECOND),
        [(f"a{i}", at(100), at(90 + i), None) for i in range(20)],
        [("tick", at(200), at(1), None)],
        [("tick", at(300), None, None)],
        schema=DUE,
    )
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def requests(spark):
    rows = [("busy" if i % 3 == 0 else f"a{i % 4}", i * 7001 % 90_000 + i * 900, i) for i in range(200)]
    return spark.createDataFrame(rows, "account_id string, ms long, event_id long")


REQUESTS = "account_id string, ms long, event_id long, ts timestamp"


def timed(rows):
    return [(account, ms, event, at(ms / 1000)) for account, ms, event in rows]


@pytest.mark.parametrize("windows", [1, 3])
def test_late_requests_get_the_verdict_of_the_batch(spark, folder, windows):
    df = requests(spark)
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])
    # Every fifth request comes up to a minute after its time.
    order = sorted(rows, key=lambda r: r[1] + (60_000 if r[2] % 5 == 0 else 0))
    tick = [("tick", 10**6, 10**6), (None, 10**6, 10**6 + 1), (None, 5, 10**6 + 2)]
    added, _ = arrive(
        spark,
        folder,
        lambda s: stateful.sliding_limit_stream(s, limit=9, window_ms=60_000, slice_windows=windows, delay="2 minutes"),
        *[timed(order[i : i + 70]) for i in (0, 70, 140)],
        timed(tick),
        schema=REQUESTS,
    )
    found = {r[2]: r[3:] for run in added for r in run}
    batch = {r["event_id"]: (r["in_window"], r["allowed"], False) for r in limits.sliding_limit(df, limit=9).collect()}
    assert found == batch | {10**6 + 1: (None, False, False), 10**6 + 2: (None, False, False)}
    assert any(not v[1] for v in batch.values())
    assert windows > 1 or (added[1] and added[2])


def test_requests_behind_the_clock_are_reported(spark, folder):
    added, _ = arrive(
        spark,
        folder,
        lambda s: stateful.sliding_limit_stream(s, limit=2, window_ms=10_000, delay="0 seconds"),
        timed([("a", 1000, 1), ("a", 25_000, 2)]),
        # Slice 0 is decided, slice 1 (10 to 20 s) too, slice 2 is open: the late one counts there.
        timed([("a", 9_000, 3), ("a", 19_500, 4), ("a", 26_000, 5), ("a", 27_000, 6), ("b", 60_000, 7)]),
        timed([("b", 80_000, 8)]),
        schema=REQUESTS,
    )
    assert added[0] == [("a", 1000, 1, 1, True, False)]
    late = [r for run in added for r in run if r[5]]
    assert sorted(late, key=lambda r: r[2]) == [("a", 9_000, 3, None, None, True), ("a", 19_500, 4, None, None, True)]
    verdicts = {r[2]: r[3:5] for run in added for r in run if not r[5]}
    assert verdicts == {1: (1, True), 2: (2, True), 5: (3, False), 6: (4, False), 7: (1, True)}


def test_status(spark, folder):
    names = ["queued", "validating", "processing", "completed", "failed"]
    rows = [(f"a{i % 3}", i, i, names[i * i % 5]) for i in range(90)]
    df = spark.createDataFrame(rows, "action_id string, ms long, event_id long, status string")
    stream = parts(spark, folder, df, "ms")
    counters.append_to(stateful.status_stream(stream), f"{folder}/out", f"{folder}/cp").awaitTermination()
    found = {r["event_id"]: (r["previous_status"], r["allowed"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    batch = lifecycle.check_transitions(df.withColumn("slice", F.floor(F.col("ms") / 10))).collect()
    assert found == {r["event_id"]: (r["previous_status"], r["allowed"]) for r in batch}


def test_only_changed_states_are_written(spark, folder):
    def rows(names, ms):
        return [(n, ms, ms, "queued") for n in names]

    added, query = arrive(
        spark,
        folder,
        stateful.status_stream,
        rows([f"a{i}" for i in range(50)], 1),
        rows(["a1", "a2", "b"], 2),
        rows(["a1"], 3) + [(None, 3, 9, "queued")],
        schema="action_id string, ms long, event_id long, status string",
    )
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in state] == [1] and state[0]["numRowsTotal"] == 51
    assert added[2] == [("a1", 3, 3, "queued", "queued", False)]


def test_counters_survive_a_repeated_batch(spark, folder):
    df = spark.createDataFrame([(f"a{i % 4}", i % 3, 0, 1, i) for i in range(60)], "action_id string, successful long, failed long, skipped long, n long")
    stream = parts(spark, folder, df, "n")
    counters.collect_increments(stream, f"{folder}/ledger", f"{folder}/cp").awaitTermination()
    expected = sorted(tuple(r) for r in stats.sum_increments(df).collect())
    assert sorted(tuple(r) for r in counters.ledger_totals(spark, f"{folder}/ledger").collect()) == expected
    # The last batch runs again, as after a crash between its write and its commit.
    again = spark.read.parquet(f"{folder}/ledger").filter("batch_id = 2").drop("batch_id").toPandas()
    spark.createDataFrame(pd.DataFrame(again)).write.mode("overwrite").parquet(f"{folder}/ledger/batch_id=2")
    assert sorted(tuple(r) for r in counters.ledger_totals(spark, f"{folder}/ledger").collect()) == expected


def test_files_are_ingested_one_by_one(spark, folder):
    rows = [(n, i, f"id{i}", "same@x.io" if i % 2 else f"u{i}@x.io", "n", "3" if i != 4 else "x") for n in range(3) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "f int, row_number int, id string, email string, name string, age string")
    delimited.write_partitioned(df.repartition("f").sortWithinPartitions("row_number"), f"{folder}/in", "f")
    names = ["row_number", "id", "email", "name", "age"]
    stream = ingest.watch_delimited(spark, f"{folder}/in", names, max_files=1)
    ingest.ingest_files(stream, f"{folder}/out", f"{folder}/cp", chunks=4).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert out.select("batch_id").distinct().count() == 3
    actions = {(r["action"], r["row_number"]): r["count"] for r in out.groupBy("action", "row_number").count().collect()}
    assert actions[("keep", 1)] == 3 and actions[("skip", 3)] == 3 and actions[(None, 4)] == 3
    assert out.filter("(chunk_index is not null) <> (action = 'keep')").count() == 0


def test_keep_first_across_batches(spark, folder):
    df = spark.createDataFrame([(f"k{i % 5}", i) for i in range(30)], "k string, n long").withColumn("ts", F.timestamp_seconds(F.col("n")))
    stream = parts(spark, folder, df, "n")
    kept = ingest.keep_first_stream(stream, "k", "ts", "1 hour")
    counters.append_to(kept, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert {r["k"] for r in spark.read.parquet(f"{folder}/out").collect()} == {f"k{i}" for i in range(5)}
    assert spark.read.parquet(f"{folder}/out").count() == 5


def test_rejected_increments_add_nothing(spark):
    df = spark.createDataFrame([("a", 5, -2, 0), ("a", 1, 2, 3), ("b", 0, 0, -1)], "action_id string, successful int, failed int, skipped int")
    assert [tuple(r) for r in stats.sum_increments(df).collect()] == [("a", 1, 2, 3)]
    assert stats.increment_errors(df).count() == 2


def test_progress_of_a_running_ingest(spark, folder):
    """One row per micro-batch; the last one has read all listed bytes."""
    rows = [(n, i, f"id{i}", f"u{n}{i}@x.io", "é" * n, "3") for n in range(4) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "f int, row_number int, id string, email string, name string, age string")
    delimited.write_partitioned(df.repartition("f").sortWithinPartitions("row_number"), f"{folder}/in", "f")
    stream = ingest.watch_delimited(spark, f"{folder}/in", ["row_number", "id", "email", "name", "age"], max_files=1)
    with batch_log.BatchLog(spark, f"{folder}/log") as log:
        log.wait(ingest.ingest_files(stream, f"{folder}/out", f"{folder}/cp", chunks=2))
    listing = files.list_files(spark, f"{folder}/in")
    report = batch_log.ingest_progress(log.batches(), spark.read.parquet(f"{folder}/out"), listing).orderBy("batch_id").collect()
    size = sum(r["length"] for r in listing.collect())
    assert len(report) == 4 and [r["processed_rows"] for r in report] == [39, 78, 117, 156]
    assert [r["total_bytes"] for r in report] == [size] * 4 and report[-1]["processed_bytes"] == size
    assert report[-1]["percentage"] == 100 and report[-1]["estimated_total_rows"] == 156 and report[-1]["remaining_ms"] == 0
    assert all(0 < a["percentage"] < b["percentage"] and a["remaining_ms"] > 0 for a, b in zip(report, report[1:]))


def state_rows(query):
    return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_actions_of_a_bucket_are_one_group(spark, folder):
    """300 waiting actions cost the state store four entries and their timers, not two entries and two timers each."""
    added, query = arrive(
        spark,
        folder,
        lambda s: stateful.due_stream(s, withdrawn=F.col("cancelled"), buckets=4),
        [(f"a{i}", at(100), at(1000 + i), None) for i in range(300)],
        [(f"a{i}", at(101), None, True) for i in range(0, 300, 3)] + [("tick", at(5000), None, None)],
        schema=DUE,
    )
    assert {name for name, _, _ in added[1]} == {f"a{i}" for i in range(300) if i % 3}
    assert 0 < state_rows(query) <= 12


class FakeState:
    """Enough of a state handle to drive a processor without a stream."""

    def __init__(self, **values):
        self.map = values

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        return self.map.get(key[0])

    def updateValue(self, key, value):
        self.map[key[0]] = value


def test_busy_action_is_returned_in_parts():
    """Rows of one action come back as frames of bounded size, nulls as nulls, in time order over all parts of the input."""
    n = 25_000
    state = FakeState(busy=("queued",), other=("completed",))
    cycle = stateful.StatusCycle([("queued", "validating"), ("validating", "queued")], None)
    cycle.init(state)
    frame = pd.DataFrame({"action_id": "busy", "status": ["queued", "validating"] * (n // 2), "no_time": False, "ms": range(n), "no_event": False, "event_id": range(n)})
    odd = pd.DataFrame({"action_id": ["other", "new"], "status": ["queued", None], "no_time": [False, True], "ms": [5, 0], "no_event": [True, False], "event_id": [0, 7]})
    backwards = [frame.iloc[k : k + 10_000] for k in range(0, n, 10_000)][::-1]
    out = list(cycle.handleInputRows((0,), iter([*backwards, odd]), None))
    assert max(map(len, out)) <= 10_000
    rows = pd.concat(out)
    busy = rows[rows["action_id"] == "busy"]
    assert busy["ms"].tolist() == list(range(n)) and busy["allowed"].tolist() == [False] + [True] * (n - 1)
    assert busy["previous_status"].tolist() == ["queued"] + frame["status"].tolist()[:-1]
    other, new = (rows[rows["action_id"] == a].iloc[0] for a in ("other", "new"))
    assert other["event_id"] is pd.NA and other["previous_status"] == "completed" and not other["allowed"]
    assert new["ms"] is pd.NA and new["status"] is None and new["previous_status"] is None and new["allowed"]
    assert state.map == {"busy": ("validating",), "other": ("queued",), "new": (None,)}


def test_requests_of_a_bucket_are_one_group(spark, folder):
    """A waiting slice has one list entry, its count and a timer per bucket, not several per account; a null event stays null."""
    rows = [(f"a{i}", 1000 + i, None if i == 7 else 2**60 + i) for i in range(300)]
    added, query = arrive(
        spark,
        folder,
        lambda s: stateful.sliding_limit_stream(s, limit=2, window_ms=10_000, delay="0 seconds", buckets=4),
        timed(rows + [("tick", 25_000, 1)]),
        timed([("tick", 26_000, 2)]),
        timed([(f"b{i}", 27_000, i) for i in range(300)]),
        schema=REQUESTS,
    )
    assert Counter((a, e, n) for a, _, e, n, _, _ in added[0]) == Counter((a, e, 1) for a, _, e in rows)
    assert 0 < state_rows(query) <= 40
