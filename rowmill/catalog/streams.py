"""Queries: the streaming forms, run to completion over what is there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowmill.catalog.inputs import (
    ACTIONS_SQL,
    CHANGE_LOG_SQL,
    CONTACT_CELLS,
    INCREMENT_CELLS,
    INCREMENTS_SQL,
    REQUEST_CELLS,
    REQUESTS_SQL,
    STATS_SQL,
    actions,
    as_list,
    change_log,
    requests,
    stats,
)
from rowmill.catalog.registry import query, read
from rowmill.catalog.statistics import SUMS_SQL
from rowmill.catalog.validation import CHECKED_SQL
from rowmill.functions.numbers import epoch_ms
from rowmill.operators import logs
from rowmill.session import scratch_dir
from rowmill.sources import delimited, files
from rowmill.spec import ENFORCED_TRANSITIONS
from rowmill.streaming import batch_log, counters, ingest, stateful


def _arriving(spark, folder, table):
    # A file source wants a folder or a pattern; this one fits a single file and a folder of files.
    return ingest.watch_parquet(spark, f"{folder}/{table}.parquet*", read(spark, folder, table).schema)


def _watch(spark, folder, table, cells):
    return _arriving(spark, folder, table).selectExpr(*as_list(cells))


def _finish(query):
    query.awaitTermination()


def _appended(spark, stream, purpose):
    path = scratch_dir(spark, purpose)
    _finish(counters.append_to(stream, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


_SPACE = 2**64 - 1


@query(
    "stream_ingest",
    f"""WITH {CHECKED_SQL}, f AS (SELECT k.*, c.c_nationkey AS nation FROM checked k JOIN customer c ON k.row_number = c.c_custkey + 1),
    v AS (SELECT *, row_number() OVER (PARTITION BY nation, email, len(errors) = 0 ORDER BY row_number) AS n FROM f)
    SELECT row_number, len(errors) = 0 AS is_valid,
      CASE WHEN len(errors) > 0 THEN NULL WHEN n = 1 THEN 'keep' ELSE 'skip' END AS action,
      CASE WHEN len(errors) = 0 AND n = 1 THEN CAST(least(CAST(CAST(('0x' || substr(sha256(lower(id)), 1, 16)) AS UBIGINT)
        AS HUGEINT) // CAST({_SPACE // 4} AS HUGEINT), 3) AS INTEGER) END AS chunk_index FROM v""",
)
def stream_ingest(spark, folder):
    path = scratch_dir(spark, "stream-ingest")
    names = list(CONTACT_CELLS)
    rows = read(spark, folder, "customer").selectExpr("c_nationkey", *as_list(CONTACT_CELLS))
    # One upload per nation.
    arranged = rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "row_number")
    delimited.write_partitioned(arranged, f"{path}/in", "c_nationkey")
    stream = ingest.watch_delimited(spark, f"{path}/in", names, max_files=10)
    _finish(ingest.ingest_files(stream, f"{path}/out", f"{path}/checkpoint", chunks=4))
    return spark.read.parquet(f"{path}/out").select("row_number", "is_valid", "action", "chunk_index")


@query(
    "ingest_progress_live",
    """WITH l AS (SELECT c_nationkey % 3 AS batch_id, c_nationkey, strlen('"' || (c_custkey + 1) || '","c-' || c_custkey || '","u' || c_custkey
        || '@x.io","' || c_name || '"' || chr(10)) AS n FROM customer),
    b AS (SELECT batch_id, count(*) AS n_rows, sum(n) + count(DISTINCT c_nationkey) * strlen('"row_number","id","email","name"' || chr(10)) AS bytes
      FROM l GROUP BY 1),
    r AS (SELECT batch_id, CAST(sum(n_rows) OVER w AS BIGINT) AS processed_rows, CAST(sum(bytes) OVER w AS BIGINT) AS processed_bytes,
      CAST((SELECT sum(bytes) FROM b) AS BIGINT) AS total_bytes FROM b WINDOW w AS (ORDER BY batch_id))
    SELECT CAST(row_number() OVER (ORDER BY batch_id) AS INTEGER) AS step, processed_rows, processed_bytes, total_bytes,
      round(processed_bytes / total_bytes::DOUBLE * 100, 6) AS percentage,
      CAST(ceil(round(total_bytes / (processed_bytes / processed_rows::DOUBLE), 6)) AS BIGINT) AS estimated_total_rows, TRUE AS is_timed FROM r""",
)
def ingest_progress_live(spark, folder):
    """Uploads of the nations, in three parts one after the other, as the listener of the running ingest reports them."""
    path = scratch_dir(spark, "ingest-live")
    names = ["row_number", "id", "email", "name"]
    cells = ["c_custkey + 1 AS row_number", "'c-' || c_custkey AS id", "'u' || c_custkey || '@x.io' AS email", "c_name AS name"]
    rows = read(spark, folder, "customer").selectExpr("c_nationkey", *cells)
    with batch_log.BatchLog(spark, f"{path}/log") as log:
        for part in range(3):
            mine = rows.filter(F.col("c_nationkey") % 3 == part).repartition("c_nationkey")
            delimited.write_partitioned(mine, f"{path}/in/part={part}", "c_nationkey")
            stream = ingest.watch_delimited(spark, f"{path}/in", names, max_files=100_000)
            log.wait(ingest.ingest_files(stream, f"{path}/out", f"{path}/checkpoint", chunks=4))
    report = batch_log.ingest_progress(log.batches(), spark.read.parquet(f"{path}/out"), files.list_files(spark, f"{path}/in"))
    # As many rows as micro-batches.
    step = F.row_number().over(Window.partitionBy("run_id").orderBy("batch_id"))
    return report.select(
        step.alias("step"),
        "processed_rows",
        "processed_bytes",
        "total_bytes",
        F.round("percentage", 6).alias("percentage"),
        "estimated_total_rows",
        ((F.col("elapsed_ms") > 0) & (F.col("rows_per_second") > 0) & F.col("remaining_ms").isNotNull()).alias("is_timed"),
    )


@query("stream_keep_first", "SELECT DISTINCT user_id FROM events")
def stream_keep_first(spark, folder):
    events = _arriving(spark, folder, "events")
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = ingest.keep_first_stream(timed, "user_id", "ts", "31 days")
    return _appended(spark, kept.select("user_id"), "stream-dedup")


def _ledger(spark, folder):
    path = scratch_dir(spark, "stream-counters")
    stream = _watch(spark, folder, "lineitem", INCREMENT_CELLS)
    _finish(counters.collect_increments(stream, f"{path}/ledger", f"{path}/checkpoint"))
    return f"{path}/ledger"


@query("stream_counters", f"WITH {INCREMENTS_SQL} {SUMS_SQL}")
def stream_counters(spark, folder):
    return counters.ledger_totals(spark, _ledger(spark, folder))


@query(
    "stream_current_stats",
    f"""WITH {STATS_SQL}, {INCREMENTS_SQL}, i AS ({SUMS_SQL})
    SELECT s.action_id, s.successful_records + coalesce(i.successful, 0) AS successful_records FROM stats s
    LEFT JOIN i ON s.action_id = i.action_id""",
)
def stream_current_stats(spark, folder):
    rows = counters.current_stats(stats(spark, folder), _ledger(spark, folder))
    return rows.select("action_id", "successful_records")


def _replayed(spark, purpose, rows, part, n, start):
    """Rows written part by part, the stream run over each; every run goes on from the checkpoint of the one before.

    ``start(stream)`` gives the rows to append.
    """
    path = scratch_dir(spark, purpose)
    for k in range(n):
        rows.filter(part == k).write.mode("append").parquet(f"{path}/in")
        out = start(ingest.watch_parquet(spark, f"{path}/in", rows.schema, max_files=100_000))
        _finish(counters.append_to(out, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _eight_days():
    return F.floor((F.dayofmonth("ts") - 1) / 8)


@query(
    "stream_status",
    f"""WITH {CHANGE_LOG_SQL}, p AS (SELECT *, lag(status) OVER (PARTITION BY action_id ORDER BY ms, event_id) AS previous_status FROM log)
    SELECT action_id, event_id, status, previous_status, previous_status IS NULL OR (previous_status || '>' || status) IN
      ({', '.join(f"'{a}>{b}'" for a, b in ENFORCED_TRANSITIONS)}) AS allowed FROM p""",
)
def stream_status(spark, folder):
    """The log in four parts by time, one after the other."""
    log = change_log(spark, folder)
    out = _replayed(spark, "stream-status", log, _eight_days(), 4, stateful.status_stream)
    return out.select("action_id", "event_id", "status", "previous_status", "allowed")


HOUR = 3_600_000
DAY = 24 * HOUR


@query(
    "stream_sliding_limit",
    f"""WITH {REQUESTS_SQL}, r AS (
      SELECT account_id, event_id, ms, least((day(ts) - 1) // 8 + CASE event_id % 50 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END, 3) AS part FROM requests),
    clocks AS (SELECT p AS part, coalesce((SELECT max(ms) FROM r WHERE r.part < p) - {2 * DAY}, 0) AS clock FROM range(0, 5) t(p)),
    held AS (
      SELECT DISTINCT r.*, s AS slice, s = ms // {DAY} AS own, (s + 1) * {DAY} <= clock AS late
      FROM (SELECT *, unnest([ms // {DAY}, (ms + {HOUR - 1}) // {DAY}]) AS s FROM r) r JOIN clocks USING (part)),
    entries AS (SELECT DISTINCT account_id, slice, ms FROM held WHERE NOT late),
    counted AS (SELECT *, count(*) OVER (PARTITION BY account_id, slice ORDER BY ms RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS n FROM entries)
    SELECT h.account_id, h.event_id, CASE WHEN NOT late THEN n END AS in_window, CASE WHEN NOT late THEN n <= 5 END AS allowed, late
    FROM held h LEFT JOIN counted c ON c.account_id = h.account_id AND c.slice = h.slice AND c.ms = h.ms
    WHERE own AND (late OR (h.slice + 1) * {DAY} <= (SELECT max(clock) FROM clocks))""",
)
def stream_sliding_limit(spark, folder):
    """Requests in four parts; a fiftieth comes one part late and another two, some too late for a verdict."""
    rows = requests(spark, folder)
    late = F.when(F.col("event_id") % 50 == 0, 1).when(F.col("event_id") % 50 == 1, 2).otherwise(0)
    out = _replayed(
        spark,
        "stream-sliding",
        rows,
        F.least(_eight_days() + late, F.lit(3)),
        4,
        lambda stream: stateful.sliding_limit_stream(stream, limit=5, window_ms=HOUR, slice_windows=24, delay="2 days"),
    )
    return out.select("account_id", "event_id", "in_window", "allowed", "late")


@query(
    "stream_sessions",
    f"""WITH {REQUESTS_SQL}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= {HOUR} THEN 1 ELSE 0 END AS opens FROM requests
      WINDOW w AS (PARTITION BY account_id ORDER BY ms, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY account_id ORDER BY ms, event_id) AS session FROM g)
    SELECT account_id, min(ms) AS start_ms, count(*) AS requests FROM s GROUP BY account_id, session
    HAVING max(ms) + {HOUR - 1} <= (SELECT max(ms) FROM requests) - 600000""",
)
def stream_sessions(spark, folder):
    rows = _watch(spark, folder, "events", REQUEST_CELLS).withColumn("ms", epoch_ms(F.col("ts")))
    timed = rows.select("account_id", F.timestamp_millis("ms").alias("ts"))
    out = _appended(spark, stateful.session_counts(timed, gap=f"{HOUR - 1} milliseconds"), "stream-sessions")
    return out.select("account_id", F.unix_millis("session_start").alias("start_ms"), "requests")


@query(
    "stream_throughput",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS events FROM events GROUP BY 1, 2)
    SELECT epoch_ms(w) AS start_ms, event_type, events FROM w
    WHERE epoch_ms(w) + 3600000 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000""",
)
def stream_throughput(spark, folder):
    events = _arriving(spark, folder, "events")
    timed = events.select("event_type", F.timestamp_millis(epoch_ms(F.col("ts"))).alias("ts"))
    out = _appended(spark, counters.throughput(timed, width="1 hour"), "stream-throughput")
    return out.select(F.unix_millis("window_start").alias("start_ms"), "event_type", "events")


@query(
    "stream_due_actions",
    f"""WITH {ACTIONS_SQL} SELECT id, epoch_ms(scheduled_at) AS due_ms FROM actions
    WHERE scheduled_at <= (SELECT max(created_at) FROM actions)""",
)
def stream_due_actions(spark, folder):
    """Orders in three parts by year. The clock is the order date, so the newest actions stay waiting."""
    part = F.floor((F.year("created_at") - 1995) / 3)
    out = _replayed(spark, "stream-due", actions(spark, folder), part, 3, stateful.due_stream)
    return out.select("id", "due_ms")


@query(
    "stream_log_labels",
    """SELECT event_id, 'api' AS job FROM events WHERE event_type = 'view'""",
)
def stream_log_labels(spark, folder):
    name = "'/demo-' || CASE event_type WHEN 'view' THEN 'api-1' WHEN 'click' THEN 'mailer' ELSE 'apix' END"
    rows = _watch(spark, folder, "events", {"event_id": "event_id", "container": name})
    labelled = logs.label_logs(rows, "demo", allow=["-api-", "-mailer"])
    return _appended(spark, labelled.filter("job IS NOT NULL").select("event_id", "job"), "stream-logs")
