"""Scan counters and ingest progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowmill.sources import delimited, files, lines


def scan_counters(validated: DataFrame) -> DataFrame:
    """Rows, valid and invalid rows in one pass."""
    return validated.agg(
        F.count(F.lit(1)).alias("processed_rows"),
        F.count_if("is_valid").alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("invalid_rows"),
    )


def measured_scan(spark: SparkSession, path: str, check: Callable[[DataFrame], DataFrame], out_path: str) -> DataFrame:
    """Read, check and write delimited files; one row of what that took.

    ``check`` adds ``is_valid``. Row counters ride on the write. ``processed_bytes`` are the sizes of the
    file blocks that the scan reported, ``total_bytes`` those of the listing, ``empty_rows`` lines without content.
    """
    started = time.monotonic()
    blocks = lines.block_table(spark, path)
    watched, seen = observe_scan(check(delimited.read_delimited(spark, path, blocks=blocks)))
    watched.write.mode("errorifexists").parquet(out_path)
    seconds = F.lit(max(time.monotonic() - started, 1e-9))
    counted = [F.lit(seen.get[c]).cast("bigint").alias(c) for c in ("processed_rows", "valid_rows", "invalid_rows")]
    read = blocks.agg(F.sum("__length").alias("processed_bytes"), F.sum("__empty").alias("empty_rows"))
    listed = files.list_files(spark, path).agg(F.sum("length").alias("total_bytes"))
    # Two tables of one row.
    both = read.withColumn("one", F.lit(1)).join(listed.withColumn("one", F.lit(1)), "one")
    return both.select(
        *counted,
        "empty_rows",
        "processed_bytes",
        "total_bytes",
        seconds.alias("seconds"),
        (F.lit(seen.get["processed_rows"]) / seconds).alias("rows_per_second"),
        (F.col("processed_bytes") / seconds).alias("bytes_per_second"),
    )


def observe_scan(validated: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The same counters riding on whatever action runs over the rows."""
    seen = Observation(name)
    return (
        validated.observe(
            seen,
            F.count(F.lit(1)).alias("processed_rows"),
            F.count_if("is_valid").alias("valid_rows"),
            F.count_if(~F.col("is_valid")).alias("invalid_rows"),
        ),
        seen,
    )


def latest_progress(batches: DataFrame, run: str = "run_id", order: str = "batch_id") -> DataFrame:
    """Last report of every run; batch rows carry running totals."""
    rest = [c for c in batches.columns if c != run]
    return batches.groupBy(run).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(run, "r.*")


def progress_report(batches: DataFrame) -> DataFrame:
    """Percent, expected rows, remaining time and rate of each progress row.

    Needs ``processed_bytes``, ``total_bytes``, ``processed_rows`` and ``elapsed_ms``.
    """
    done, total = F.col("processed_bytes"), F.col("total_bytes")
    rows, elapsed = F.col("processed_rows"), F.col("elapsed_ms")
    share = F.when(total > 0, done / F.nullif(total, F.lit(0)) * 100).otherwise(F.lit(0.0))
    per_row = done / F.nullif(rows, F.lit(0))
    expected = F.when(
        (total > 0) & (done > 0) & (rows > 0), F.ceil(total / F.nullif(per_row, F.lit(0.0)))
    ).otherwise(rows)
    speed = done / F.nullif(elapsed, F.lit(0))
    left = F.when((total > 0) & (done > 0) & (elapsed > 0), (total - done) / F.nullif(speed, F.lit(0.0)))
    rate = F.when(elapsed > 0, rows / F.nullif(elapsed, F.lit(0)) * 1000)
    return batches.withColumns(
        {
            "percentage": F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)),
            "estimated_total_rows": expected.cast("bigint"),
            "remaining_ms": F.coalesce(left, F.lit(0.0)),
            "rows_per_second": F.coalesce(rate, F.lit(0.0)),
        }
    )
