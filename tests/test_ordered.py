import random

import pytest
from pyspark.sql import functions as F

from rowmill.functions.ordered import previous_values, running_totals
from rowmill.operators import limits, lifecycle


def log(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [
        ("busy" if i % 3 == 0 else f"a{rng.randint(0, 4)}", rng.randint(0, 900) * 997 % 700_000, i) for i in range(n)
    ]
    return spark.createDataFrame(rows, "account_id string, ms long, event_id long"), rows


@pytest.mark.parametrize("slices", [1, 5])
def test_sliding_window_equals_a_loop(spark, slices):
    df, rows = log(spark)
    found = limits.sliding_limit(df, limit=12, window_ms=60_000, slice_windows=slices).collect()
    assert len(found) == len(rows)
    for r in found:
        seen = {ms for a, ms, _ in rows if a == r["account_id"] and r["ms"] - 60_000 < ms <= r["ms"]}
        assert r["in_window"] == len(seen) and r["allowed"] == (len(seen) <= 12)


def test_sliding_window_borders(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 59_999, 3), ("a", 60_000, 4), ("a", 120_000, 5), (None, 5, 6)], "account_id string, ms long, event_id long")
    found = {r["event_id"]: (r["in_window"], r["allowed"]) for r in limits.sliding_limit(df, slice_windows=1).collect()}
    assert found == {1: (1, True), 2: (1, True), 3: (2, True), 4: (2, True), 5: (1, True), 6: (None, False)}


@pytest.mark.parametrize("slice_ms", [1_000, 17_000, 10_000_000])
def test_expiring_counter_equals_a_loop(spark, slice_ms):
    df, rows = log(spark)
    found = {
        r["event_id"]: (r["current"], r["allowed"], r["remaining"])
        for r in limits.session_limit(df, limit=4, window_ms=9_000, slice_ms=slice_ms).collect()
    }
    count, last = {}, {}
    for account, ms, event in sorted(rows, key=lambda r: (r[1], r[2])):
        fresh = account not in last or ms - last[account] >= 9_000
        count[account] = 1 if fresh else count[account] + 1
        last[account] = ms
        assert found[event] == (count[account], count[account] <= 4, max(0, 4 - count[account]))


def test_expiring_counter_border(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 59_999, 2), ("a", 119_999, 3)], "account_id string, ms long, event_id long")
    found = {r["event_id"]: r["current"] for r in limits.session_limit(df).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_running_totals_and_previous_values(spark, width):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", i, rng.choice([None, i % 7])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n long, v long").withColumn("s", F.floor(F.col("n") / width))
    total, before = {}, {}
    sums = {r["n"]: (r["t"], r["c"]) for r in running_totals(df, ["k"], "s", ["n"], {"t": F.coalesce("v", F.lit(0)), "c": F.lit(1)}).collect()}
    previous = {r["n"]: r["p"] for r in previous_values(df, ["k"], "s", ["n"], {"p": "v"}).collect()}
    for k, n, v in rows:
        t, c = total.get(k, (0, 0))
        total[k] = (t + (v or 0), c + 1)
        assert sums[n] == total[k]
        assert previous[n] == before.get(k)
        before[k] = v


def test_transitions(spark):
    rows = [("a", 1, 1, "queued"), ("a", 2, 2, "validating"), ("a", 3, 3, "completed"), ("b", 1, 4, "failed"), ("b", 2, 5, "queued"), ("b", 3, 6, "processing"), ("b", 9, 7, "completed"), ("b", 10, 8, "queued")]
    df = spark.createDataFrame(rows, "action_id string, ms long, event_id long, status string").withColumn("slice", F.floor(F.col("ms") / 2))
    checked = lifecycle.check_transitions(df)
    found = {r["event_id"]: r["allowed"] for r in checked.collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}
    times = {r["action_id"]: (r["started_ms"], r["completed_ms"], r["status"], r["rejected"]) for r in lifecycle.status_times(checked).collect()}
    assert times == {"a": (None, None, "validating", 1), "b": (3, 9, "completed", 1)}


def test_cleanup_takes_the_oldest_up_to_the_cap(spark):
    rows = [("q", "completed", i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "queue string, state string, finished_ms long, job_id long")
    assert lifecycle.expired_jobs(df, 10_000_000).count() == 500
    gone = lifecycle.expired_jobs(df, 10_000_000, batches=lifecycle.CLEANUP_BATCHES)
    assert {r["job_id"] for r in gone.collect()} == set(range(200))
    assert "WindowGroupLimit" in gone._jdf.queryExecution().executedPlan().toString()
    assert lifecycle.expired_jobs(df, 3_600_000 + 100).count() == 100


def test_sessions_of_one_account_in_one_minute(spark):
    """All requests of one account within a minute, most of them in one millisecond: no group exceeds its slice."""
    rows = [("hot", 5 if i % 3 else i * 20 % 60_000, i) for i in range(3000)] + [("hot", 200_000, 3000), ("b", 7, 3001)]
    df = spark.createDataFrame(rows, "account_id string, ms long, event_id long").repartition(6)
    limited = limits.session_limit(df, limit=1000, slice_ms=1000, slice_ties=100)
    found = {r["event_id"]: (r["current"], r["allowed"], r["remaining"]) for r in limited.collect()}
    order = sorted((r for r in rows if r[0] == "hot" and r[1] < 200_000), key=lambda r: r[1:])
    expected = {r[2]: (n, n <= 1000, max(0, 1000 - n)) for n, r in enumerate(order, 1)}
    assert found == expected | {3000: (1, True, 999), 3001: (1, True, 999)}
    folds = df.groupBy("account_id", "ms", F.floor(F.col("event_id") / 100)).count()
    assert folds.agg(F.max("count")).first()[0] <= 100
