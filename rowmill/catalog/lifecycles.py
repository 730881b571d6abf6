"""Queries: status changes, scheduling, clean-up, job events and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import ACTIONS_SQL, CHANGE_LOG_SQL, actions, change_log
from rowmill.catalog.registry import query, read
from rowmill.functions.numbers import epoch_ms, floor_div
from rowmill.operators import lifecycle, logs
from rowmill.spec import ENFORCED_TRANSITIONS, MODEL_TRANSITIONS

_CHECKED_SQL = f"""{CHANGE_LOG_SQL}, p AS (SELECT *, lag(status) OVER (PARTITION BY action_id ORDER BY ms, event_id)
      AS previous_status FROM log),
    checked AS (SELECT *, previous_status IS NULL OR (previous_status || '>' || status) IN ({{}}) AS allowed FROM p)"""


def _pairs(table) -> str:
    return ", ".join(f"'{a}>{b}'" for a, b in table)


def _checked(spark, folder, table=ENFORCED_TRANSITIONS):
    rows = change_log(spark, folder).withColumn("slice", floor_div(F.col("ms"), 7_200_000))
    return lifecycle.check_transitions(rows, transitions=table)


@query(
    "status_transitions",
    f"""WITH {_CHECKED_SQL.format(_pairs(ENFORCED_TRANSITIONS))}
    SELECT action_id, event_id, status, previous_status, allowed FROM checked""",
)
def status_transitions(spark, folder):
    return _checked(spark, folder).select("action_id", "event_id", "status", "previous_status", "allowed")


@query(
    "status_transitions_model",
    f"""WITH {_CHECKED_SQL.format(_pairs(MODEL_TRANSITIONS))}
    SELECT previous_status, status, count(*) AS changes, count(*) FILTER (allowed) AS allowed FROM checked GROUP BY 1, 2""",
)
def status_transitions_model(spark, folder):
    return _checked(spark, folder, MODEL_TRANSITIONS).groupBy("previous_status", "status").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if("allowed").alias("allowed")
    )


@query(
    "status_times",
    f"""WITH {_CHECKED_SQL.format(_pairs(ENFORCED_TRANSITIONS))}
    SELECT action_id, max(ms) FILTER (allowed AND status = 'processing') AS started_ms,
      max(ms) FILTER (allowed AND status IN ('completed', 'failed', 'cancelled')) AS completed_ms,
      arg_max(status, ms::HUGEINT * 1000000000000 + event_id) FILTER (allowed) AS status,
      count(*) FILTER (NOT allowed) AS rejected FROM checked GROUP BY action_id""",
)
def status_times(spark, folder):
    return lifecycle.status_times(_checked(spark, folder))


@query(
    "due_actions",
    f"""WITH {ACTIONS_SQL}, t AS (SELECT id, scheduled_at, TIMESTAMP '1997-06-01' AS n FROM actions WHERE scheduled_at IS NOT NULL)
    SELECT id, greatest(0, epoch_ms(scheduled_at) - epoch_ms(n)) AS delay_ms, scheduled_at <= n AS is_due FROM t""",
)
def due_actions(spark, folder):
    now = F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")
    return lifecycle.due_actions(actions(spark, folder), now).select("id", "delay_ms", "is_due")


_NOW_MS = 1_706_400_000_000


@query(
    "expired_jobs",
    f"""WITH j AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'q-busy' ELSE 'q-' || (user_id % 10) END AS queue, event_id AS job_id,
      CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'active' ELSE 'completed' END AS state,
      CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS finished_ms FROM events),
    o AS (SELECT * FROM j WHERE
      (state = 'completed' AND {_NOW_MS} - finished_ms > 3600000) OR (state = 'failed' AND {_NOW_MS} - finished_ms > 21600000))
    SELECT queue, state, job_id FROM o""",
)
def expired_jobs(spark, folder):
    rows = read(spark, folder, "events").select(
        F.when(F.col("user_id") % 3 == 0, "q-busy")
        .otherwise(F.concat(F.lit("q-"), F.col("user_id") % 10))
        .alias("queue"),
        F.col("event_id").alias("job_id"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "active")
        .otherwise("completed")
        .alias("state"),
        epoch_ms(F.col("ts")).alias("finished_ms"),
    )
    return lifecycle.expired_jobs(rows, _NOW_MS).select("queue", "state", "job_id")


@query(
    "event_throughput",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2""",
)
def event_throughput(spark, folder):
    return lifecycle.event_throughput(read(spark, folder, "events"), width="1 hour")


_NAME_SQL = """CASE WHEN user_id % 7 = 0 THEN '/other-' || event_type ELSE '/demo-' ||
    CASE user_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'minio-init' WHEN 2 THEN 'chunking-workers' ELSE 'mailer' END ||
    CASE WHEN event_id % 2 = 0 THEN '-' || (event_id % 3) ELSE '' END END"""


def _containers(spark, folder):
    return read(spark, folder, "events").selectExpr("event_id", f"{_NAME_SQL} AS container")


@query(
    "log_labels",
    f"""WITH c AS (SELECT event_id, {_NAME_SQL} AS container FROM events)
    SELECT event_id, substr(container, 2) AS container_name,
      nullif(regexp_extract(container, '^/demo-(api|chunking-workers|minio-init|minio)(-.*)?$', 1), '') AS job FROM c
    WHERE regexp_matches(container, 'demo-api|demo-minio|other-')""",
)
def log_labels(spark, folder):
    rows = logs.label_logs(_containers(spark, folder), "demo", allow=["demo-api", "demo-minio", "other-"])
    return rows.select("event_id", "container_name", "job")


@query(
    "log_meta_labels",
    """WITH c AS (SELECT event_id, user_id % 9 AS k FROM events),
    n AS (SELECT event_id, k, CASE k WHEN 0 THEN '/demo-api-1' WHEN 1 THEN '/demo-db-seed-1' WHEN 2 THEN '/x-redis' WHEN 3 THEN '/demo-redis-1'
      WHEN 4 THEN '/other-db-seed-2' WHEN 5 THEN '/demo-processing-workers-7' WHEN 6 THEN '/x-loki' WHEN 7 THEN '/mailer' ELSE '/other-api-2' END AS name FROM c)
    SELECT event_id, substr(name, 2) AS container_name, CASE k WHEN 0 THEN 'api' WHEN 1 THEN 'db-seed' WHEN 5 THEN 'processing-workers' END AS job,
      'img:' || k AS image, 'id' || event_id AS instance, CASE WHEN event_id % 3 = 0 THEN 'stderr' ELSE 'stdout' END AS log_stream
    FROM n WHERE k NOT IN (3, 4, 7)""",
)
def log_meta_labels(spark, folder):
    """Rows of the containers on the default list, with all labels."""
    names = ["demo-api-1", "demo-db-seed-1", "x-redis", "demo-redis-1", "other-db-seed-2", "demo-processing-workers-7", "x-loki", "mailer", "other-api-2"]
    kind = (F.col("user_id") % 9).cast("int")
    rows = read(spark, folder, "events").select(
        "event_id",
        F.concat(F.lit("/"), F.get(F.array(*[F.lit(n) for n in names]), kind)).alias("container"),
        F.concat(F.lit("img:"), kind).alias("container_image"),
        F.concat(F.lit("id"), "event_id").alias("container_id"),
        F.when(F.col("event_id") % 3 == 0, "stderr").otherwise("stdout").alias("stream"),
    )
    labelled = logs.label_logs(rows, "demo", allow=logs.default_allow("demo", "x"))
    return labelled.select("event_id", "container_name", "job", "image", "instance", "log_stream")


def _parsed(spark, folder):
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug").otherwise("info")
    line = F.concat(
        F.lit('{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('.000Z","level":"'), level,
        F.lit('","message":"m","service":"s","traceId":"t-'), F.col("event_id") % 200,
        F.lit('","accountId":"u-'), F.col("user_id"), F.lit('"}'),
    )
    rows = read(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 50 == 0, "not json").otherwise(line).alias("value")
    )
    return logs.parse_logs(rows)


_PARSED_SQL = """l AS (SELECT CASE WHEN event_id % 50 <> 0 THEN date_trunc('second', ts) END AS ts,
    CASE WHEN event_id % 50 <> 0 THEN CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END END AS level,
    CASE WHEN event_id % 50 <> 0 THEN 't-' || (event_id % 200) END AS trace_id FROM events)"""


@query("log_levels", f"WITH {_PARSED_SQL} SELECT level, count(*) AS lines FROM l GROUP BY level")
def log_levels(spark, folder):
    return logs.level_counts(_parsed(spark, folder))


@query(
    "log_traces",
    f"""WITH {_PARSED_SQL} SELECT trace_id, count(*) AS lines, count(*) FILTER (level = 'error') AS errors,
      epoch_ms(max(ts)) - epoch_ms(min(ts)) AS span_ms FROM l WHERE trace_id IS NOT NULL GROUP BY trace_id""",
)
def log_traces(spark, folder):
    rows = logs.trace_summary(_parsed(spark, folder))
    span = F.timestamp_diff("MILLISECOND", F.col("first_ts"), F.col("last_ts"))
    return rows.select("trace_id", "lines", "errors", span.alias("span_ms"))


@query(
    "log_retention",
    f"""WITH {_PARSED_SQL} SELECT level, count(*) AS lines FROM l
    WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 7 DAY GROUP BY level""",
)
def log_retention(spark, folder):
    now = F.to_timestamp(F.lit("2024-01-28T00:00:00Z"))
    return logs.level_counts(logs.retained(_parsed(spark, folder), now))
