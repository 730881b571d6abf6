"""Counters that grow with a stream, exactly once.

Each micro-batch writes its summed increments under its own batch id. The
totals are the sum over the ledger, so a repeated batch replaces its own rows
and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowmill.operators.stats import apply_increments, sum_increments
from rowmill.streaming.ingest import write_batches


def collect_increments(
    increments: DataFrame, ledger: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Sum ``successful``, ``failed`` and ``skipped`` per action into the ledger."""
    return write_batches(increments, sum_increments, ledger, checkpoint, available_now)


def ledger_totals(spark: SparkSession, ledger: str) -> DataFrame:
    return sum_increments(spark.read.parquet(ledger))


def current_stats(stats: DataFrame, ledger: str) -> DataFrame:
    """Stored counters plus everything in the ledger."""
    return apply_increments(stats, stats.sparkSession.read.parquet(ledger))


def throughput(events: DataFrame, ts: str = "ts", width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events per window and type on a stream; late rows are dropped after ``delay``."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events")
    )


def append_to(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append finished rows of a stream to Parquet files."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
