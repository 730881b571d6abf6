"""Hash-range chunks of kept rows and the reports about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import ring, text
from rowmill.functions.numbers import floor_div

NAMINGS = ("sequential", "hash_range", "hybrid")


@dataclass(frozen=True)
class ChunkOptions:
    """Checked chunking arguments. The number of chunks has no ceiling; see ``plan_options``."""

    chunks: int
    field: str = "id"
    algorithm: str = "sha256"
    naming: str = "sequential"

    def __post_init__(self) -> None:
        problems = []
        if self.chunks < 1:
            problems.append("chunks must be at least 1")
        if not self.field.strip():
            problems.append("field is required")
        if self.naming not in NAMINGS:
            problems.append(f"naming must be one of {', '.join(NAMINGS)}")
        if problems:
            raise ValueError("Invalid chunking options: " + "; ".join(problems))
        object.__setattr__(self, "field", self.field.strip())


def plan_chunks(rows: Column, target: int) -> dict[str, Column]:
    """Chunk count for about ``target`` rows each, size and minimum size for a row count, as columns.

    An empty input still gets one chunk of size one.
    """
    chunks = F.greatest(F.lit(1), F.ceil(rows / F.lit(target))).cast("int")
    size = F.ceil(rows / chunks)
    return {
        "chunks": chunks,
        "max_rows": F.greatest(F.lit(1), size).cast("bigint"),
        "min_rows": F.floor(size * F.lit(0.1)).cast("bigint"),
    }


def plan_options(rows: int, target: int, **options) -> ChunkOptions:
    """The same choice for one known row count."""
    return ChunkOptions(chunks=max(1, -(-rows // target)), **options)


def hash_key(c: Column) -> Column:
    """Lower-cased and stripped key, null when nothing is left."""
    return text.non_empty(text.strip(F.lower(c.cast("string"))))


def assign_chunks(df: DataFrame, options: ChunkOptions, count: Column | None = None) -> DataFrame:
    """Kept rows with their ``chunk_index``.

    Skipped rows are dropped when an ``action`` column says so; a row without a
    hash key gets a null index, see ``unassigned_rows``. ``count`` overrides the
    chunk count per row so that many uploads are chunked in one job.
    """
    rows = df.filter(F.col("action") != "skip") if "action" in df.columns else df
    key = hash_key(F.col(options.field))
    n = options.chunks if count is None else count
    return rows.withColumn("chunk_index", ring.chunk_index(key, n, options.algorithm))


def unassigned_rows(assigned: DataFrame) -> DataFrame:
    """Rows whose hash key is missing."""
    return assigned.filter(F.col("chunk_index").isNull())


def row_size(columns: list[str]) -> Column:
    """Estimated bytes of a row: names, separators, values and a fixed overhead."""
    names = sum(len(c) + 1 for c in columns) + 10
    values = [F.coalesce(text.unit_length(F.col(c).cast("string")), F.lit(0)) for c in columns]
    total = F.lit(names)
    for v in values:
        total = total + v
    return total.cast("bigint")


def chunk_file_name(index: Column, start: Column, end: Column, naming: str = "sequential") -> Column:
    if naming not in NAMINGS:
        raise ValueError(f"unknown naming: {naming}")
    number = pad_index(index)
    span = F.concat_ws("-", start, end)
    if naming == "sequential":
        return F.concat(F.lit("chunk_"), number, F.lit(".csv"))
    if naming == "hash_range":
        return F.concat(F.lit("chunk_"), span, F.lit(".csv"))
    return F.concat(F.lit("chunk_"), number, F.lit("_"), span, F.lit(".csv"))


def pad_index(index: Column) -> Column:
    """Index with at least three digits."""
    digits = index.cast("string")
    return F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0"))


def chunk_id(index: Column, run: Column, field: str) -> Column:
    """Stable id of a chunk within a run."""
    seed = F.concat_ws("-", index.cast("string"), run, F.lit(field))
    return F.concat(F.lit("chunk-"), pad_index(index), F.lit("-"), F.substring(F.md5(seed), 1, 8))


def chunk_metadata(
    assigned: DataFrame,
    options: ChunkOptions,
    run: str = "run",
    order: str = "row_number",
    size_columns: list[str] | None = None,
) -> DataFrame:
    """One row per non-empty chunk: counts, first and last row, size, range, name, id."""
    cells = size_columns or [c for c in assigned.columns if c not in ("chunk_index", order)]
    rows = assigned.filter(F.col("chunk_index").isNotNull())
    grouped = rows.groupBy("chunk_index").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(order).alias("start_record"),
        F.max(order).alias("end_record"),
        F.sum(row_size(cells)).alias("estimated_size"),
    )
    index = F.col("chunk_index")
    ranged = grouped.withColumns(
        {
            "hash_range_start": ring.range_start(index, options.chunks),
            "hash_range_end": ring.range_end(index, options.chunks),
        }
    )
    return ranged.withColumns(
        {
            "chunk_id": chunk_id(index, F.lit(run), options.field),
            "file_name": chunk_file_name(
                index, F.col("hash_range_start"), F.col("hash_range_end"), options.naming
            ),
            "status": F.lit("completed"),
        }
    )


def chunk_distribution(metadata: DataFrame) -> DataFrame:
    """Spread of rows over the non-empty chunks, one row."""
    n = F.col("record_count")
    return metadata.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_hashes"),
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("average_records"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_records"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_records"),
        F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("standard_deviation"),
    )


def chunk_shares(metadata: DataFrame) -> DataFrame:
    """Share of every chunk in all rows, in percent."""
    total = metadata.select(F.sum("record_count")).scalar()
    return metadata.select(
        "chunk_index",
        "hash_range_start",
        "hash_range_end",
        "record_count",
        (F.col("record_count") / total * 100).alias("percentage"),
    )


# Texts of the balance verdict.
ISSUE_VARIATION = "High variation in chunk sizes"
ISSUE_EMPTY = "All chunks are empty"
ISSUE_IMBALANCE = "Significant imbalance between smallest and largest chunks"
ADVICE_VARIATION = "Consider increasing the number of chunks or using a different hash field"
ADVICE_EMPTY = "Check hash field extraction and data validity"
ADVICE_IMBALANCE = "Consider using more chunks or different hash distribution"


def chunk_balance(distribution: DataFrame) -> DataFrame:
    """Verdict on a distribution row: balanced or not, issues and advice."""
    varied = F.col("standard_deviation") / F.nullif(F.col("average_records"), F.lit(0.0)) > 0.3
    empty = F.col("chunks") == 0
    skewed = F.col("min_records") / F.nullif(F.col("max_records"), F.lit(0)) < 0.5
    checks = [
        (varied, ISSUE_VARIATION, ADVICE_VARIATION),
        (empty, ISSUE_EMPTY, ADVICE_EMPTY),
        (skewed, ISSUE_IMBALANCE, ADVICE_IMBALANCE),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(i)) for c, i, _ in checks]))
    advice = F.array_compact(F.array(*[F.when(c, F.lit(a)) for c, _, a in checks]))
    return distribution.withColumns(
        {"issues": issues, "recommendations": advice}
    ).withColumn("is_balanced", F.size("issues") == 0)


def chunk_partition(start: Column, partitions: int = 5) -> Column:
    """Work partition of a chunk from the first 32 bits of its range start."""
    head = F.conv(F.substring(start, 1, 8), 16, 10).cast("bigint")
    return (head % partitions).cast("int")


def partition_distribution(metadata: DataFrame, partitions: int = 5) -> DataFrame:
    """Chunks per work partition, partitions without chunks included."""
    counts = (
        metadata.select(chunk_partition(F.col("hash_range_start"), partitions).alias("partition_id"))
        .groupBy("partition_id")
        .agg(F.count(F.lit(1)).alias("chunks"))
    )
    every = metadata.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    return every.join(counts, "partition_id", "left").select(
        "partition_id", F.coalesce("chunks", F.lit(0)).alias("chunks")
    )


def partition_jobs(metadata: DataFrame, partitions: int = 5) -> DataFrame:
    """One row per chunk job: its work partition, chunk and rows."""
    return metadata.select(
        chunk_partition(F.col("hash_range_start"), partitions).alias("partition_id"), "chunk_index", "record_count"
    )


def partition_totals(jobs: DataFrame) -> DataFrame:
    """Jobs and rows per work partition."""
    return jobs.groupBy("partition_id").agg(F.count(F.lit(1)).alias("jobs"), F.sum("record_count").alias("records"))


def partition_lists(jobs: DataFrame) -> DataFrame:
    """Jobs, rows and the chunks in order per work partition; a list is as long as the partition has chunks."""
    return jobs.groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("record_count").alias("records"),
        F.sort_array(F.collect_list("chunk_index")).alias("chunk_indexes"),
    )


def batch_number(row_number: Column, size: int = 1000) -> Column:
    """Number of the write batch of a row, from 0."""
    return floor_div(row_number - 1, size)
