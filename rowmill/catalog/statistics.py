"""Queries: counters, rates, completion and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import (
    ACTIONS_SQL,
    INCREMENTS_SQL,
    LINE_NUMBER,
    STATS_SQL,
    actions,
    increments,
    stats,
)
from rowmill.catalog.registry import query, read
from rowmill.functions.numbers import floor_div
from rowmill.operators import stats as ops


def _pct(part: str, total: str = "total_records") -> str:
    return f"CASE WHEN {total} > 0 THEN floor(({part}) / CAST({total} AS DOUBLE) * 100 * 100 + 0.5) / 100.0 ELSE 0.0 END"


@query(
    "action_rates",
    f"""WITH {STATS_SQL} SELECT *, successful_records + failed_records + skipped_records AS processed_records,
      {_pct('successful_records')} AS success_rate, {_pct('failed_records')} AS failure_rate,
      {_pct('skipped_records')} AS skip_rate,
      {_pct('successful_records + failed_records + skipped_records')} AS completion_rate FROM stats""",
)
def action_rates(spark, folder):
    return ops.rates(stats(spark, folder))


@query(
    "stats_consistency",
    f"""WITH {STATS_SQL}, s AS (SELECT action_id, total_records - 2 AS total_records, successful_records, failed_records,
      skipped_records - 1 AS skipped_records FROM stats)
    SELECT action_id, concat_ws(';',
      CASE WHEN successful_records + failed_records + skipped_records > total_records THEN 'Processed records exceed total records' END,
      CASE WHEN total_records < 0 THEN 'Total records cannot be negative' END,
      CASE WHEN skipped_records < 0 THEN 'Skipped records cannot be negative' END) AS problems FROM s""",
)
def stats_consistency(spark, folder):
    rows = stats(spark, folder).withColumns(
        {"total_records": F.col("total_records") - 2, "skipped_records": F.col("skipped_records") - 1}
    )
    return ops.consistency(rows).select("action_id", F.array_join("problems", ";").alias("problems"))


@query(
    "rejected_updates",
    f"""WITH {STATS_SQL} SELECT action_id FROM stats
    WHERE total_records < 2 * successful_records + failed_records + skipped_records""",
)
def rejected_updates(spark, folder):
    table = stats(spark, folder)
    changes = table.select("action_id", (F.col("successful_records") * 2).alias("successful_records"))
    return ops.rejected_updates(table, changes).select("action_id")


SUMS_SQL = """SELECT action_id, CAST(sum(successful) AS BIGINT) AS successful, CAST(sum(failed) AS BIGINT) AS failed,
    CAST(sum(skipped) AS BIGINT) AS skipped FROM increments
    WHERE NOT (successful < 0 OR failed < 0 OR skipped < 0) GROUP BY action_id"""


@query(
    "increment_counters",
    f"""WITH {STATS_SQL}, {INCREMENTS_SQL}, i AS ({SUMS_SQL})
    SELECT s.action_id, s.total_records, s.successful_records + coalesce(i.successful, 0) AS successful_records,
      s.failed_records + coalesce(i.failed, 0) AS failed_records, s.skipped_records + coalesce(i.skipped, 0) AS skipped_records
    FROM stats s LEFT JOIN i ON s.action_id = i.action_id""",
)
def increment_counters(spark, folder):
    return ops.apply_increments(stats(spark, folder), increments(spark, folder))


@query("increment_sums", f"WITH {INCREMENTS_SQL} {SUMS_SQL}")
def increment_sums(spark, folder):
    return ops.sum_increments(increments(spark, folder))


@query(
    "increment_errors",
    f"""WITH {INCREMENTS_SQL} SELECT action_id, failed, 'Failed increment cannot be negative' AS error FROM increments
    WHERE failed < 0""",
)
def increment_errors(spark, folder):
    return ops.increment_errors(increments(spark, folder)).select("action_id", "failed", "error")


@query(
    "chunk_results",
    """WITH o AS (SELECT 'a-' || (l_orderkey % 50) AS action_id, CAST(l_suppkey % 7 AS BIGINT) AS chunk_id, CASE l_returnflag WHEN 'N' THEN 'updated'
      WHEN 'A' THEN 'skipped' ELSE CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'created' END END AS outcome,
      CAST(l_quantity AS BIGINT) AS ms FROM lineitem)
    SELECT action_id, chunk_id, count(*) AS records_processed, count(*) FILTER (outcome IN ('updated', 'created')) AS records_successful,
      count(*) FILTER (outcome = 'failed') AS records_failed, count(*) FILTER (outcome = 'skipped') AS records_skipped,
      count(*) FILTER (outcome = 'created') AS inserts, count(*) FILTER (outcome = 'updated') AS updates,
      count(*) FILTER (outcome = 'skipped') AS conflicts, count(*) FILTER (outcome = 'failed') AS errors,
      CAST(sum(ms) AS BIGINT) AS duration_ms, round(count(*) / (CAST(sum(ms) AS DOUBLE) / 1000.0), 6) AS processing_rate,
      count(*) FILTER (outcome = 'failed') = 0 AS success FROM o GROUP BY 1, 2""",
)
def chunk_results(spark, folder):
    outcome = (
        F.when(F.col("l_returnflag") == "N", "updated")
        .when(F.col("l_returnflag") == "A", "skipped")
        .when(F.col("l_linestatus") == "F", "failed")
        .otherwise("created")
    )
    rows = read(spark, folder, "lineitem").select(
        F.concat(F.lit("a-"), F.col("l_orderkey") % 50).alias("action_id"),
        (F.col("l_suppkey") % 7).alias("chunk_id"),
        outcome.alias("outcome"),
        F.col("l_quantity").cast("bigint").alias("duration_ms"),
    )
    return ops.chunk_results(rows).withColumn("processing_rate", F.round("processing_rate", 6))


def _completion_sql(done: str) -> str:
    return f"""WITH {ACTIONS_SQL}, {STATS_SQL}, s AS (SELECT action_id, total_records AS t,
      successful_records + failed_records + skipped_records AS p FROM stats)
    SELECT a.id, CASE WHEN {done} THEN 'completed' ELSE a.status END AS status FROM actions a LEFT JOIN s ON a.id = s.action_id"""


@query("completion", _completion_sql("p = t"))
def completion(spark, folder):
    return ops.complete_actions(actions(spark, folder), stats(spark, folder)).select("id", "status")


@query("completion_at_least", _completion_sql("p >= t AND a.status = 'processing'"))
def completion_at_least(spark, folder):
    rows = ops.complete_actions(actions(spark, folder), stats(spark, folder), at_least=True)
    return rows.select("id", "status")


@query("count_filtered", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def count_filtered(spark, folder):
    from rowmill.operators.paging import where_equal

    rows = where_equal(read(spark, folder, "orders"), {"o_orderstatus": "F", "o_custkey": 7, "o_orderdate": None})
    return rows.agg(F.count(F.lit(1)).alias("total"))


@query("count_by_status", f"WITH {ACTIONS_SQL} SELECT status, count(*) AS count FROM actions GROUP BY status")
def count_by_status(spark, folder):
    return ops.count_by_status(actions(spark, folder))


@query(
    "action_overview",
    f"""WITH {ACTIONS_SQL}, t AS (SELECT status, entity_type, action_type,
      CASE WHEN status IN ('completed', 'failed') THEN 30 + total_entities % 600 END AS s FROM actions)
    SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(entity_type) = 0 THEN 'entity_type'
        WHEN grouping(action_type) = 0 THEN 'action_type' ELSE 'all' END AS dimension,
      coalesce(status, entity_type, action_type, 'all') AS value, count(*) AS actions, round(avg(s), 6) AS mean_seconds,
      count(*) FILTER (status = 'completed') AS completed,
      floor(CAST(count(*) FILTER (status = 'completed') * 10000 AS DOUBLE) / count(*) + 0.5) / 100 AS success_rate
    FROM t GROUP BY GROUPING SETS ((), (status), (entity_type), (action_type))""",
)
def action_overview(spark, folder):
    rows = actions(spark, folder)
    seconds = F.when(F.col("status").isin("completed", "failed"), 30 + F.col("total_entities") % 600)
    timed = rows.withColumns(
        {"started_at": F.col("created_at"), "completed_at": F.timestamp_add("SECOND", seconds, F.col("created_at"))}
    )
    return ops.action_overview(timed).withColumn("mean_seconds", F.round("mean_seconds", 6))


_JOBS_SQL = """jobs AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'q-busy' ELSE 'q-' || (user_id % 20) END AS queue, event_id,
    CASE WHEN user_id % 3 = 0 THEN 'processing' ELSE 'chunking' END AS kind, ts,
    CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'view' THEN 'active' WHEN 'error' THEN 'failed'
      WHEN 'click' THEN CASE WHEN event_id % 10 = 0 THEN 'delayed' ELSE 'completed' END ELSE 'completed' END AS state FROM events)"""


def jobs(spark, folder):
    busy = F.col("user_id") % 3 == 0
    state = (
        F.when(F.col("event_type") == "signup", "waiting")
        .when(F.col("event_type") == "view", "active")
        .when(F.col("event_type") == "error", "failed")
        .when((F.col("event_type") == "click") & (F.col("event_id") % 10 == 0), "delayed")
        .otherwise("completed")
    )
    return read(spark, folder, "events").select(
        F.when(busy, "q-busy").otherwise(F.concat(F.lit("q-"), F.col("user_id") % 20)).alias("queue"),
        F.when(busy, "processing").otherwise("chunking").alias("kind"),
        state.alias("state"),
        "event_id",
        "ts",
    )


@query(
    "queue_health",
    f"""WITH {_JOBS_SQL}, c AS (SELECT queue, kind, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ops.JOB_STATES)}
      FROM jobs GROUP BY 1, 2), r AS (SELECT *,
      CASE WHEN waiting + active + failed > 0 THEN failed / CAST(waiting + active + failed AS DOUBLE) * 100 ELSE 0 END AS f,
      CASE WHEN kind = 'processing' THEN 50000 ELSE 300 END AS hi, CASE WHEN kind = 'processing' THEN 10000 ELSE 100 END AS lo FROM c)
    SELECT queue, kind, {', '.join(ops.JOB_STATES)},
      round(CASE WHEN completed + failed > 0 THEN failed / CAST(completed + failed AS DOUBLE) * 100 ELSE 0.0 END, 6) AS failure_rate,
      CASE WHEN f > 50 OR waiting + active > hi THEN 'unhealthy' WHEN f > 20 OR waiting + active > lo THEN 'degraded'
        ELSE 'healthy' END AS status FROM r""",
)
def queue_health(spark, folder):
    limits = {"processing": (50_000, 10_000), "chunking": (300, 100)}
    return ops.queue_health(jobs(spark, folder), limits=limits).withColumn(
        "failure_rate", F.round("failure_rate", 6)
    )


@query(
    "jobs_of_actions",
    f"""WITH {_JOBS_SQL} SELECT queue AS action_id, CAST(event_id % 5 AS BIGINT) AS partition_id, count(*) AS jobs,
      {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ops.JOB_STATES)} FROM jobs GROUP BY 1, 2""",
)
def jobs_of_actions(spark, folder):
    rows = jobs(spark, folder).select(
        F.col("queue").alias("action_id"), (F.col("event_id") % 5).alias("partition_id"), "state"
    )
    return ops.jobs_of_actions(rows)


@query(
    "worker_totals",
    """WITH w AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'chunking' ELSE 'processing' END AS worker_type,
      s_acctbal > 1000 AS ok, CASE WHEN s_nationkey % 4 = 0 THEN 'processing' ELSE 'idle' END AS status,
      s_suppkey * 3 AS mem, s_nationkey * 10 AS jobs, s_nationkey * 9 AS good, s_nationkey AS bad,
      s_nationkey % 5 * 100 AS ms FROM supplier)
    SELECT coalesce(worker_type, 'all') AS worker_type, count(*) AS workers, count(*) FILTER (ok) AS healthy,
      count(*) FILTER (NOT ok) AS unhealthy, count(*) FILTER (status = 'processing') AS processing,
      CAST(sum(mem) AS BIGINT) AS total_memory, round(avg(mem), 6) AS average_memory, CAST(sum(jobs) AS BIGINT) AS jobs_processed,
      CAST(sum(good) AS BIGINT) AS jobs_successful, CAST(sum(bad) AS BIGINT) AS jobs_failed,
      round(coalesce(avg(ms) FILTER (ms > 0), 0.0), 6) AS average_processing_time,
      round(sum(jobs) / 120.0::DOUBLE, 6) AS throughput FROM w GROUP BY GROUPING SETS ((), (worker_type))""",
)
def worker_totals(spark, folder):
    workers = read(spark, folder, "supplier").select(
        F.when(F.col("s_suppkey") % 3 == 0, "chunking").otherwise("processing").alias("worker_type"),
        (F.col("s_acctbal") > 1000).alias("is_healthy"),
        F.when(F.col("s_nationkey") % 4 == 0, "processing").otherwise("idle").alias("status"),
        (F.col("s_suppkey") * 3).alias("memory_usage"),
        (F.col("s_nationkey") * 10).alias("jobs_processed"),
        (F.col("s_nationkey") * 9).alias("jobs_successful"),
        F.col("s_nationkey").alias("jobs_failed"),
        (F.col("s_nationkey") % 5 * 100).alias("avg_processing_time"),
    )
    out = ops.worker_totals(workers, 120.0)
    names = ("average_memory", "average_processing_time", "throughput")
    return out.withColumns({c: F.round(c, 6) for c in names})


_RUNS = """runs AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'w-busy' ELSE 'w-' || (l_suppkey % 10) END AS worker,
    {0} AS n, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'failed' END AS result,
    CAST(l_quantity AS BIGINT) * 10 AS ms, l_partkey AS records FROM lineitem)""".format(LINE_NUMBER)


def _runs(spark, folder):
    return read(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "w-busy")
        .otherwise(F.concat(F.lit("w-"), F.col("l_suppkey") % 10))
        .alias("worker"),
        F.expr(LINE_NUMBER).alias("n"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("result"),
        (F.col("l_quantity").cast("bigint") * 10).alias("duration_ms"),
        F.col("l_partkey").alias("records"),
    )


@query(
    "worker_means",
    f"""WITH {_RUNS} SELECT worker, count(*) AS jobs_processed, count(*) FILTER (result = 'completed') AS jobs_successful,
      count(*) FILTER (result = 'failed') AS jobs_failed,
      CAST(sum(records) FILTER (result = 'completed') AS BIGINT) AS records_processed,
      round(avg(ms) FILTER (result = 'completed'), 4) AS mean_duration_ms,
      round(avg(records / (ms / 1000.0::DOUBLE)) FILTER (result = 'completed'), 4) AS mean_rows_per_second FROM runs GROUP BY worker""",
)
def worker_means(spark, folder):
    out = ops.worker_means(_runs(spark, folder))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_duration_ms", "mean_rows_per_second")})


@query(
    "running_means",
    f"""WITH {_RUNS}, t AS (SELECT worker, n,
      CAST(sum(CASE WHEN result = 'completed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS jobs_so_far,
      sum(CASE WHEN result = 'completed' THEN ms ELSE 0 END) OVER w AS ms,
      sum(CASE WHEN result = 'completed' AND ms > 0 THEN records / (ms / 1000.0::DOUBLE) ELSE 0 END) OVER w AS speed FROM runs
      WINDOW w AS (PARTITION BY worker ORDER BY n))
    SELECT worker, n, jobs_so_far, CASE WHEN jobs_so_far > 0 THEN CAST(ms AS DOUBLE) / jobs_so_far ELSE 0.0 END
      AS mean_duration_ms, CASE WHEN jobs_so_far > 0 THEN round(speed / jobs_so_far, 4) ELSE 0.0 END AS mean_rows_per_second FROM t""",
)
def running_means(spark, folder):
    rows = _runs(spark, folder).withColumn("slice", floor_div(F.col("n"), 1_000_000_000_000))
    out = ops.running_means(rows, "worker", "slice", "n")
    return out.select("worker", "n", "jobs_so_far", "mean_duration_ms", F.round("mean_rows_per_second", 4).alias("mean_rows_per_second"))


@query(
    "latency_objectives",
    """WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN '/busy' ELSE '/e' || (l_suppkey % 10) END AS endpoint,
      CAST(l_quantity AS BIGINT) * (l_partkey % 30) AS ms, l_linenumber = 7 AND l_discount > 0.09 AS bad FROM lineitem)
    SELECT endpoint, count(*) AS requests, count(*) FILTER (bad) AS errors, quantile_disc(ms, 0.95) AS p95_ms,
      quantile_disc(ms, 0.99) AS p99_ms, count(*) FILTER (ms <= 300) AS satisfied,
      count(*) FILTER (ms > 300 AND ms <= 1200) AS tolerating,
      round((count(*) FILTER (ms <= 300) + count(*) FILTER (ms > 300 AND ms <= 1200) / 2.0::DOUBLE) / count(*), 6) AS apdex,
      quantile_disc(ms, 0.95) < 300 AS meets_p95, quantile_disc(ms, 0.99) < 500 AS meets_p99,
      count(*) FILTER (bad) = 0 AS meets_errors FROM r GROUP BY endpoint""",
)
def latency_objectives(spark, folder):
    rows = read(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "/busy")
        .otherwise(F.concat(F.lit("/e"), F.col("l_suppkey") % 10))
        .alias("endpoint"),
        (F.col("l_quantity").cast("bigint") * (F.col("l_partkey") % 30)).alias("duration_ms"),
        ((F.col("l_linenumber") == 7) & (F.col("l_discount") > 0.09)).alias("is_error"),
    )
    return ops.latency_objectives(rows).withColumn("apdex", F.round("apdex", 6))
