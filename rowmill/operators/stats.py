"""Counters, rates, completion and health summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.numbers import percent, ratio
from rowmill.functions.ordered import running_totals

COUNTERS = ("successful_records", "failed_records", "skipped_records")

# Texts of the consistency report.
EXCEEDS = "Processed records exceed total records"
NEGATIVE = (
    ("total_records", "Total records cannot be negative"),
    ("successful_records", "Successful records cannot be negative"),
    ("failed_records", "Failed records cannot be negative"),
    ("skipped_records", "Skipped records cannot be negative"),
)


def processed() -> Column:
    return F.col("successful_records") + F.col("failed_records") + F.col("skipped_records")


def rates(stats: DataFrame) -> DataFrame:
    """Success, failure, skip and completion rate per action, in percent."""
    total = F.col("total_records")
    return stats.withColumn("processed_records", processed()).withColumns(
        {
            "success_rate": percent(F.col("successful_records"), total),
            "failure_rate": percent(F.col("failed_records"), total),
            "skip_rate": percent(F.col("skipped_records"), total),
            "completion_rate": percent(F.col("processed_records"), total),
        }
    )


def consistency(stats: DataFrame) -> DataFrame:
    """Add the list of broken counter rules and whether there is none."""
    checks = [F.when(processed() > F.col("total_records"), F.lit(EXCEEDS))]
    checks += [F.when(F.col(c) < 0, F.lit(message)) for c, message in NEGATIVE]
    return stats.withColumn("problems", F.array_compact(F.array(*checks))).withColumn(
        "is_consistent", F.size("problems") == 0
    )


def rejected_updates(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """Counter changes whose result would be inconsistent; a null counter leaves it as it is."""
    names = ["total_records", *COUNTERS]
    new = changes.select("action_id", *[F.col(c).alias(f"__new_{c}") for c in names if c in changes.columns])
    joined = stats.join(new, "action_id")
    would = joined.select(
        "action_id",
        *[
            (F.coalesce(F.col(f"__new_{c}"), F.col(c)) if f"__new_{c}" in joined.columns else F.col(c)).alias(c)
            for c in names
        ],
    )
    return consistency(would).filter(~F.col("is_consistent"))


def increment_errors(increments: DataFrame) -> DataFrame:
    """Increment rows with a negative counter, with a message.

    All-zero rows are no-ops, not errors: a chunk without counted rows is legal.
    """
    message = F.coalesce(
        *[
            F.when(F.col(name) < 0, F.lit(f"{name.capitalize()} increment cannot be negative"))
            for name in ("successful", "failed", "skipped")
        ]
    )
    return increments.withColumn("error", message).filter(F.col("error").isNotNull())


def sum_increments(increments: DataFrame) -> DataFrame:
    """Increments summed per action.

    A row with a negative counter is rejected whole (see ``increment_errors``), so
    none of its counters is added.
    """
    names = ("successful", "failed", "skipped")
    accepted = ~F.coalesce(F.least(*[F.coalesce(c, F.lit(0)) for c in names]) < 0, F.lit(False))
    return increments.filter(accepted).groupBy("action_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    )


def apply_increments(stats: DataFrame, increments: DataFrame) -> DataFrame:
    """Counters plus the sum of their increments; unknown actions are ignored."""
    added = sum_increments(increments)
    joined = stats.join(added, "action_id", "left")
    pairs = dict(zip(COUNTERS, ("successful", "failed", "skipped")))
    return joined.select(
        *[
            (F.col(c) + F.coalesce(F.col(pairs[c]), F.lit(0))).alias(c) if c in pairs else F.col(c)
            for c in stats.columns
        ]
    )


def chunk_results(outcomes: DataFrame, by: Sequence[str] = ("action_id", "chunk_id")) -> DataFrame:
    """Write outcomes rolled up per chunk: counters, rate and success.

    Needs ``outcome`` and ``duration_ms``; the chunk time is the sum of its rows'.
    """
    is_failure = F.col("outcome").isin("failed", "error")
    grouped = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records_processed"),
        F.count_if(F.col("outcome").isin("created", "updated")).alias("records_successful"),
        F.count_if(is_failure).alias("records_failed"),
        F.count_if(F.col("outcome") == "skipped").alias("records_skipped"),
        F.count_if(F.col("outcome") == "created").alias("inserts"),
        F.count_if(F.col("outcome") == "updated").alias("updates"),
        F.count_if(F.col("outcome") == "skipped").alias("conflicts"),
        F.count_if(is_failure).alias("errors"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    seconds = F.nullif(F.col("duration_ms"), F.lit(0)) / F.lit(1000.0)
    return grouped.withColumns(
        {
            "processing_rate": F.coalesce(F.col("records_processed") / seconds, F.lit(0.0)),
            "success": F.col("records_failed") == 0,
        }
    )


def complete_actions(actions: DataFrame, stats: DataFrame, at_least: bool = False) -> DataFrame:
    """Actions with the status after the completion check.

    The default needs processed to equal total; ``at_least`` also completes an
    action that is processing and has counted more.
    """
    counted = stats.select(
        F.col("action_id").alias("id"), processed().alias("__done"), F.col("total_records").alias("__total")
    )
    joined = actions.join(counted, "id", "left")
    done = F.col("__done") == F.col("__total")
    if at_least:
        done = (F.col("__done") >= F.col("__total")) & (F.col("status") == "processing")
    status = F.when(F.coalesce(done, F.lit(False)), "completed").otherwise(F.col("status"))
    return joined.select(*[status.alias(c) if c == "status" else F.col(c) for c in actions.columns])


def run_result(marked: DataFrame, by: Sequence[str] = (), seconds: float | None = None) -> DataFrame:
    """Totals of a run over validated and marked rows.

    Needs ``is_valid``, ``action`` and ``chunk_index``; action and chunk are null on invalid rows.
    """
    out = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_valid").alias("valid_records"),
        F.count_if(~F.col("is_valid")).alias("invalid_records"),
        F.count_if(F.col("action") == "skip").alias("skipped_records"),
        F.count_distinct("chunk_index").alias("chunks_created"),
    )
    if seconds is not None:
        out = out.withColumn("processing_rate", F.col("total_records") / F.lit(float(seconds)))
    return out


def run_stats(result: DataFrame, action: Column) -> DataFrame:
    """Run totals as a statistics row: invalid rows failed, duplicates skipped."""
    return result.select(
        action.alias("action_id"),
        "total_records",
        F.lit(0).cast("bigint").alias("successful_records"),
        F.col("invalid_records").alias("failed_records"),
        "skipped_records",
    )


def count_by_status(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(column)


def action_overview(actions: DataFrame) -> DataFrame:
    """Counts, mean processing time and success rate overall and per status, entity and action type."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))
    base = actions.select("status", "entity_type", "action_type", seconds.alias("s"))
    status, entity, kind = F.col("status"), F.col("entity_type"), F.col("action_type")
    sets = base.groupingSets([[], [status], [entity], [kind]], status, entity, kind).agg(
        F.count(F.lit(1)).alias("actions"),
        F.avg("s").alias("mean_seconds"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.grouping_id().alias("g"),
    )
    # grouping_id has a bit per column that is rolled up: status 4, entity 2, action 1.
    dimension = (
        F.when(F.col("g") == 7, "all")
        .when(F.col("g") == 3, "status")
        .when(F.col("g") == 5, "entity_type")
        .otherwise("action_type")
    )
    return sets.select(
        dimension.alias("dimension"),
        F.coalesce("status", "entity_type", "action_type", F.lit("all")).alias("value"),
        "actions",
        "mean_seconds",
        "completed",
        (F.floor(F.col("completed") * 10_000 / F.col("actions") + 0.5) / 100).alias("success_rate"),
    )


JOB_STATES = ("waiting", "active", "completed", "failed", "delayed", "stalled")

# Backlog limits per queue kind (unhealthy, degraded).
BACKLOG_LIMITS = {"processing": (50_000, 10_000), "chunking": (10_000, 5_000)}


def queue_health(jobs: DataFrame, by: str = "queue", limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Job counts by state, failure rate and health per queue.

    ``kind`` names the limits of a queue; without it the processing limits hold.
    """
    limits = BACKLOG_LIMITS if limits is None else limits
    keys = [by] + (["kind"] if "kind" in jobs.columns else [])
    counts = jobs.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s) for s in JOB_STATES])
    finished = F.col("completed") + F.col("failed")
    open_jobs = F.col("waiting") + F.col("active")
    failing = ratio(F.col("failed"), open_jobs + F.col("failed")) * 100
    kind = F.col("kind") if "kind" in jobs.columns else F.lit("processing")

    def limit(position: int) -> Column:
        chosen = F.lit(limits["processing"][position])
        for name, pair in limits.items():
            chosen = F.when(kind == name, F.lit(pair[position])).otherwise(chosen)
        return chosen

    status = (
        F.when((failing > 50) | (open_jobs > limit(0)), "unhealthy")
        .when((failing > 20) | (open_jobs > limit(1)), "degraded")
        .otherwise("healthy")
    )
    return counts.withColumn("failure_rate", ratio(F.col("failed"), finished) * 100).withColumn("status", status)


def jobs_of_actions(jobs: DataFrame, keys: Sequence[str] = ("action_id", "partition_id")) -> DataFrame:
    """Jobs per action and work partition, by state."""
    return jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs"),
        *[F.count_if(F.col("state") == s).alias(s) for s in JOB_STATES],
    )


def worker_totals(workers: DataFrame, uptime_minutes: float) -> DataFrame:
    """Worker metrics overall and per type.

    ``uptime_minutes`` is the age of the manager; the throughput divides by it.
    """
    kind = F.col("worker_type")
    positive_time = F.when(F.col("avg_processing_time") > 0, F.col("avg_processing_time"))
    grouped = workers.groupingSets([[], [kind]], kind).agg(
        F.count(F.lit(1)).alias("workers"),
        F.count_if("is_healthy").alias("healthy"),
        F.count_if(~F.col("is_healthy")).alias("unhealthy"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.sum("memory_usage").alias("total_memory"),
        F.avg("memory_usage").alias("average_memory"),
        F.sum("jobs_processed").alias("jobs_processed"),
        F.sum("jobs_successful").alias("jobs_successful"),
        F.sum("jobs_failed").alias("jobs_failed"),
        F.coalesce(F.avg(positive_time), F.lit(0.0)).alias("average_processing_time"),
    )
    per_minute = F.col("jobs_processed") / F.lit(float(uptime_minutes)) if uptime_minutes > 0 else F.lit(0.0)
    return grouped.withColumn("throughput", per_minute).withColumn(
        "worker_type", F.coalesce("worker_type", F.lit("all"))
    )


def worker_means(jobs: DataFrame, by: Sequence[str] = ("worker",)) -> DataFrame:
    """Mean duration and mean rows per second of the completed jobs."""
    done = F.col("result") == "completed"
    speed = F.col("records") / (F.nullif(F.col("duration_ms"), F.lit(0)) / F.lit(1000.0))
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs_processed"),
        F.count_if(done).alias("jobs_successful"),
        F.count_if(~done).alias("jobs_failed"),
        F.coalesce(F.sum(F.when(done, F.col("records"))), F.lit(0)).alias("records_processed"),
        F.avg(F.when(done, F.col("duration_ms"))).alias("mean_duration_ms"),
        F.avg(F.when(done, speed)).alias("mean_rows_per_second"),
    )


def running_means(jobs: DataFrame, key: str, slice_col: str, order: str) -> DataFrame:
    """Mean duration and mean rows per second of the completed jobs so far, at every job of a worker."""
    done = F.col("result") == "completed"
    speed = F.col("records") / (F.nullif(F.col("duration_ms"), F.lit(0)) / F.lit(1000.0))
    totals = running_totals(
        jobs,
        [key],
        slice_col,
        [F.col(order)],
        {
            "jobs_so_far": F.when(done, 1).otherwise(0),
            "__ms": F.when(done, F.col("duration_ms")).otherwise(0),
            "__speed": F.coalesce(F.when(done, speed), F.lit(0.0)),
        },
    )
    means = {"mean_duration_ms": ratio(F.col("__ms"), F.col("jobs_so_far")), "mean_rows_per_second": ratio(F.col("__speed"), F.col("jobs_so_far"))}
    return totals.withColumns(means).drop("__ms", "__speed")


def latency_objectives(
    requests: DataFrame,
    by: Sequence[str] = ("endpoint",),
    p95_below: int = 300,
    p99_below: int = 500,
    apdex_ms: int = 300,
) -> DataFrame:
    """p95, p99, error count and Apdex per endpoint, with pass flags.

    Percentiles are exact (smallest time that covers the share). Requests are
    first counted per millisecond value, so the ordered step sees at most one
    row per distinct value however many requests an endpoint has.
    """
    ms = F.col("duration_ms")
    histogram = requests.groupBy(*by, "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors")
    )
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumns({"__upto": F.sum("n").over(upto), "__all": F.sum("n").over(whole)})

    def covers(share: int) -> Column:
        return F.col("__upto") * 100 >= F.col("__all") * share

    out = ranked.groupBy(*by).agg(
        F.sum("n").alias("requests"),
        F.sum("errors").alias("errors"),
        F.min(F.when(covers(95), ms)).alias("p95_ms"),
        F.min(F.when(covers(99), ms)).alias("p99_ms"),
        F.coalesce(F.sum(F.when(ms <= apdex_ms, F.col("n"))), F.lit(0)).alias("satisfied"),
        F.coalesce(
            F.sum(F.when((ms > apdex_ms) & (ms <= 4 * apdex_ms), F.col("n"))), F.lit(0)
        ).alias("tolerating"),
    )
    apdex = (F.col("satisfied") + F.col("tolerating") / F.lit(2.0)) / F.col("requests")
    return out.withColumns(
        {
            "apdex": apdex,
            "meets_p95": F.col("p95_ms") < p95_below,
            "meets_p99": F.col("p99_ms") < p99_below,
            "meets_errors": F.col("errors") == 0,
        }
    )
