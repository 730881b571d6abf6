"""Status changes, domain checks of action and job rows, scheduling, retry and clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions import text
from rowmill.functions.ordered import previous_values
from rowmill.spec import (
    ACCOUNT_SHAPE,
    ACTION_STATUSES,
    CONFLICT_MODES,
    ENFORCED_TRANSITIONS,
    UUID_SHAPE,
)

START_STATUSES = ("processing",)
END_STATUSES = ("completed", "failed", "cancelled")


def is_allowed(old: Column, new: Column, transitions: Iterable[tuple[str, str]] = ENFORCED_TRANSITIONS) -> Column:
    """Whether a status change is in the table of allowed ones."""
    steps = F.concat_ws(">", old, new)
    return steps.isin([f"{a}>{b}" for a, b in transitions])


def check_transitions(
    changes: DataFrame,
    key: str = "action_id",
    order: Sequence[str] = ("ms", "event_id"),
    slice_col: str = "slice",
    status: str = "status",
    transitions: Iterable[tuple[str, str]] = ENFORCED_TRANSITIONS,
) -> DataFrame:
    """Every status change with its predecessor and verdict.

    The verdict compares neighbouring rows of the log; the first row of an
    action has no predecessor and is accepted. ``slice_col`` must grow with the
    order, for example the hour of the change.
    """
    stepped = previous_values(changes, [key], slice_col, list(order), {"previous_status": status})
    ok = F.col("previous_status").isNull() | is_allowed(
        F.col("previous_status"), F.col(status), list(transitions)
    )
    return stepped.withColumn("allowed", ok)


def status_times(checked: DataFrame, key: str = "action_id", ms: str = "ms", status: str = "status") -> DataFrame:
    """Start and end instants set by the allowed changes, and the last allowed status."""
    at = F.when(F.col("allowed"), F.col(ms))
    position = F.when(F.col("allowed"), F.struct(F.col(ms), F.col("event_id")))
    return checked.groupBy(key).agg(
        F.max(F.when(F.col(status).isin(*START_STATUSES), at)).alias("started_ms"),
        F.max(F.when(F.col(status).isin(*END_STATUSES), at)).alias("completed_ms"),
        F.max_by(status, position).alias("status"),
        F.count_if(~F.col("allowed")).alias("rejected"),
    )


def _failed(checks: Sequence[tuple[Column, str]]) -> Column:
    """Messages of the checks that hold; an unknown (null) check does not hold."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(message)) for broken, message in checks]))


def check_actions(actions: DataFrame, now: Column | None = None, uuid_key: bool = True) -> DataFrame:
    """Add ``problems`` with every domain rule an action row breaks."""
    instant = F.current_timestamp() if now is None else now
    account = F.col("account_id")
    conflict = F.get_json_object("configuration", "$.onConflict")
    checks = [
        (text.is_blank(account), "Account ID is required"),
        (~text.is_blank(account) & ~account.rlike(ACCOUNT_SHAPE), "Invalid account ID format"),
        (~F.coalesce(F.col("entity_type"), F.lit("")).isin("contact"), "Invalid entity type"),
        (~F.coalesce(F.col("action_type"), F.lit("")).isin("bulk_update"), "Invalid action type"),
        (~F.coalesce(F.col("status"), F.lit("queued")).isin(*ACTION_STATUSES), "Invalid status"),
        (F.col("total_entities") < 0, "Total entities cannot be negative"),
        (F.col("scheduled_at") <= instant, "Scheduled time must be in the future"),
        (conflict.isNotNull() & ~conflict.isin(*CONFLICT_MODES), "Invalid conflict mode"),
    ]
    if uuid_key:
        checks.insert(0, (~F.coalesce(F.col("id"), F.lit("")).rlike(UUID_SHAPE), "Invalid UUID format"))
    return actions.withColumn("problems", _failed(checks)).withColumn("is_valid", F.size("problems") == 0)


def check_progress(actions: DataFrame, processed: str = "processed_entities") -> DataFrame:
    """Progress updates outside 0 to the total of the action."""
    checks = [
        (F.col(processed) < 0, "Processed entities cannot be negative"),
        (F.col(processed) > F.col("total_entities"), "Processed entities cannot exceed total entities"),
    ]
    return actions.withColumn("problems", _failed(checks))


def check_jobs(jobs: DataFrame) -> DataFrame:
    """Add ``problems`` to job rows; the rules depend on the columns the job kind has."""
    checks = []
    for name in ("action_id", "account_id", "chunk_id", "chunk_path", "file_path", "entity_type", "action_type"):
        if name in jobs.columns:
            checks.append((text.is_blank(F.col(name)), f"{name} is required"))
    for name in ("record_count", "chunk_index", "estimated_entity_count"):
        if name in jobs.columns:
            checks.append((F.col(name) < 0, f"{name} cannot be negative"))
    if "total_chunks" in jobs.columns:
        checks.append((F.col("total_chunks") < 1, "total_chunks must be at least 1"))
    if "file_size" in jobs.columns:
        checks.append((F.col("file_size") <= 0, "file_size must be greater than 0"))
    return jobs.withColumn("problems", _failed(checks)).withColumn("is_valid", F.size("problems") == 0)


def action_config(configuration: Column) -> dict[str, Column]:
    """Settings of an action with their defaults; both spellings of the switch are read."""
    parsed = F.from_json(
        configuration, "deduplicate boolean, deduplication boolean, onConflict string, filePath string"
    )
    return {
        "deduplicate": F.coalesce(parsed["deduplicate"], parsed["deduplication"], F.lit(False)),
        "on_conflict": F.coalesce(parsed["onConflict"], F.lit("skip")),
        "file_path": parsed["filePath"],
    }


# Message patterns of failures that are worth a retry.
RETRY_PATTERNS = ("timeout", "connection", "network", "temporary", "rate limit")
LOCK_PATTERNS = ("deadlock", "lock")


def is_retryable(kind: Column, message: Column, locks: bool = True) -> Column:
    """Validation failures never retry, known errors by message, unknown ones always.

    ``locks`` adds the patterns of the write jobs.
    """
    patterns = RETRY_PATTERNS + (LOCK_PATTERNS if locks else ())
    matches = message.rlike("(?i)" + "|".join(patterns))
    return F.when(kind == "validation", False).when(message.isNull(), True).otherwise(matches)


def error_stage(kind: Column) -> Column:
    return F.when(kind == "validation", "validation").when(kind == "database", "storage").otherwise("processing")


def due_actions(actions: DataFrame, now: Column) -> DataFrame:
    """Scheduled actions with their delay; ``is_due`` when the time has come."""
    waiting = F.timestamp_diff("MILLISECOND", now, F.col("scheduled_at"))
    return actions.filter(F.col("scheduled_at").isNotNull()).withColumns(
        {"delay_ms": F.greatest(F.lit(0), waiting).cast("bigint"), "is_due": F.col("scheduled_at") <= now}
    )


# State, age in milliseconds; and the rows that one clean-up run takes per queue.
CLEANUP_RULES = (("completed", 3_600_000), ("failed", 21_600_000))
CLEANUP_BATCHES = {"completed": 200, "failed": 100}


def expired_jobs(
    jobs: DataFrame,
    now_ms: int,
    queue: str = "queue",
    rules: Sequence[tuple[str, int]] = CLEANUP_RULES,
    batches: dict[str, int] | None = None,
) -> DataFrame:
    """All finished jobs that are older than their state's rule allows.

    With ``batches`` (state to rows) only the oldest jobs of each queue that one
    clean-up run takes, such as ``CLEANUP_BATCHES``; Spark's grouped limit then keeps at
    most that many rows per task before the shuffle.
    """
    state = F.col("state")
    age = F.lit(now_ms) - F.col("finished_ms")
    is_old = F.lit(False)
    for name, max_age in rules:
        is_old = is_old | ((state == name) & (age > max_age))
    expired = jobs.filter(is_old)
    if batches is None:
        return expired
    cap = F.lit(0)
    for name, rows in batches.items():
        cap = F.when(state == name, F.lit(rows)).otherwise(cap)
    ranked = expired.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(queue, "state").orderBy("finished_ms", "job_id"))
    )
    return ranked.filter(F.col("__rank") <= max(batches.values())).filter(F.col("__rank") <= cap).drop("__rank")


def event_throughput(events: DataFrame, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """Job events per time window and type."""
    return events.groupBy(F.window(ts, width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events")
    ).select(F.col("w.start").alias("window_start"), "event_type", "events")
