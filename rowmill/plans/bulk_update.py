"""The main flow: raw rows to an updated table with counters.

validate -> mark duplicates among the valid rows -> assign chunks -> match with
the target -> outcomes, new state and statistics. One shuffle on the duplicate
key for the verdicts and one on the id for the match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators import chunking, dedup, merge, stats, validate
from rowmill.session import scratch_dir
from rowmill.spec import CONTACTS, EntitySpec


@dataclass(frozen=True)
class BulkUpdateOptions:
    """Arguments of one run; ``dedup_key`` None switches duplicate handling off."""

    strict: bool = False
    empty_optional: str = "error"
    dedup_key: str | None = "email"
    strategy: str = "keep_first"
    target_rows: int = 1000
    order: str = "row_number"


def check(rows: DataFrame, options: BulkUpdateOptions = BulkUpdateOptions(), spec: EntitySpec = CONTACTS) -> DataFrame:
    """Every row with its cleaned values, errors and validity."""
    return validate.validate(
        rows, spec, strict=options.strict, empty_optional=options.empty_optional, keep=(options.order,)
    )


def _dedup_key(options: BulkUpdateOptions) -> Column:
    # Invalid rows fall into the group without a key instead of being filtered: a
    # filter would be pushed below the rules and evaluate all of them twice.
    return F.when(F.col("is_valid"), dedup.normalize_key(F.col(options.dedup_key)))


def survivors(checked: DataFrame, options: BulkUpdateOptions) -> DataFrame:
    """Row number of the valid row that stands for each duplicate key."""
    if options.strategy not in ("keep_first", "keep_last", "mark_all"):
        raise ValueError("a run marks rows; merge them with dedup.merge_per_key first")
    return dedup.surviving_rows(
        checked, _dedup_key(options), options.order, last=options.strategy == "keep_last"
    )


def mark(checked: DataFrame, options: BulkUpdateOptions) -> DataFrame:
    """Duplicate verdict of every valid row; invalid rows have none.

    Only the folded first (or last) row number per key is shuffled by key. The
    rows meet it on the unique row number, so a frequent key skews nothing.
    """
    if options.dedup_key is None:
        return checked.withColumn("action", F.when(F.col("is_valid"), "keep"))
    numbers = survivors(checked, options)
    repeat = "review" if options.strategy == "mark_all" else "skip"
    stays = F.coalesce("__survives", F.lit(False)) | _dedup_key(options).isNull()
    return (
        checked.join(numbers.withColumn("__survives", F.lit(True)), options.order, "left")
        .withColumn("action", F.when(F.col("is_valid"), F.when(stays, "keep").otherwise(repeat)))
        .drop("__survives")
    )


def annotate(rows: DataFrame, options: BulkUpdateOptions = BulkUpdateOptions(), spec: EntitySpec = CONTACTS) -> DataFrame:
    """Every row with its errors and duplicate verdict."""
    return mark(check(rows, options, spec), options)


def _written(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def route(annotated: DataFrame, chunks: int, spec: EntitySpec = CONTACTS) -> DataFrame:
    """Chunk index of every valid row that is not skipped; null on the others."""
    options = chunking.ChunkOptions(chunks=chunks, field=spec.key)
    key = chunking.hash_key(F.col(spec.key))
    index = chunking.ring.chunk_index(key, options.chunks, options.algorithm)
    flows = F.col("is_valid") & (F.col("action") != "skip")
    return annotated.withColumn("chunk_index", F.when(flows, index))


@dataclass(frozen=True)
class BulkUpdateRun:
    """Lazy results of a run over persisted annotated rows."""

    annotated: DataFrame
    outcomes: DataFrame
    new_state: DataFrame
    result: DataFrame
    folders: tuple[str, ...] = ()

    def close(self) -> None:
        """Remove the written tables; the lazy results cannot be read after that."""
        spark = self.annotated.sparkSession
        for folder in self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(
    rows: DataFrame,
    target: DataFrame,
    options: BulkUpdateOptions = BulkUpdateOptions(),
    spec: EntitySpec = CONTACTS,
    now: Column | None = None,
) -> BulkUpdateRun:
    """Validate, deduplicate, route and apply one upload.

    The checked rows are written to the shared folder once, so the rules run
    once; of the duplicate verdicts only the row number and the action are
    written. Later reads take only the columns they need, and a lost executor
    re-reads files instead of the whole lineage. ``BulkUpdateRun.close`` removes both.
    """
    checked, wide = _written(check(rows, options, spec), "checked")
    folders = [wide]
    annotated = mark(checked, options)
    if options.dedup_key is not None:
        verdicts, narrow = _written(annotated.select(options.order, "action"), "verdicts")
        folders.append(narrow)
        annotated = checked.join(verdicts, options.order)
    valid = checked.agg(F.count_if(F.col("is_valid"))).first()[0]
    planned = chunking.plan_options(valid, options.target_rows)
    routed = route(annotated, planned.chunks, spec)
    kept = routed.filter(F.col("chunk_index").isNotNull()).select(
        options.order, *[c for c in ("id", "email", "name", "age") if c in routed.columns], "chunk_index"
    )
    records = kept.withColumn("age", F.col("age").cast("int"))
    outcomes = merge.update_outcomes(records, target, spec, options.order)
    accepted = validate.check_records(records, spec).filter(F.col("problem").isNull())
    new_state = merge.bulk_update(target, accepted, spec.key, ("name", "age"), options.order, now)
    return BulkUpdateRun(routed, outcomes, new_state, stats.run_result(routed), tuple(folders))


def statistics(run_: BulkUpdateRun, action: str) -> DataFrame:
    """Statistics row of a run after its writes: total, successful, failed, skipped."""
    totals = stats.run_stats(run_.result, F.lit(action))
    written = merge.outcome_counts(run_.outcomes).select(
        F.lit(action).alias("action_id"),
        F.col("successful").alias("successful"),
        F.col("failed").alias("failed"),
        F.lit(0).cast("bigint").alias("skipped"),
    )
    return stats.apply_increments(totals, written)
