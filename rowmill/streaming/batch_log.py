"""Progress of a running stream: one written row per micro-batch."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rowmill.sources.progress import progress_report

SCHEMA = "run_id string, batch_id bigint, input_rows bigint, batch_ms bigint, ended_ms bigint"


class BatchLog(StreamingQueryListener):
    """Writes a row for every micro-batch with rows, of all streams that run while it is registered.

    The row of a batch has a folder of its own, ``run_id=.../batch_id=...``, so a batch that runs again
    replaces it. Use as a context manager around the stream, or register it with ``spark.streams``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}

    def __enter__(self) -> BatchLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure: object) -> None:
        self.spark.streams.removeListener(self)

    def _end_of(self, start: str) -> threading.Event:
        return self.ended.setdefault(start, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        report = event.progress
        if not report.numInputRows:
            return
        started = datetime.fromisoformat(report.timestamp.replace("Z", "+00:00"))
        row = (report.numInputRows, report.batchDuration, int(started.timestamp() * 1000) + report.batchDuration)
        written = self.spark.createDataFrame([row], "input_rows bigint, batch_ms bigint, ended_ms bigint").coalesce(1)
        written.write.mode("overwrite").parquet(f"{self.path}/run_id={report.id}/batch_id={report.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until a stream has ended and all its batches are written."""
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError("the stream's last report has not come")

    def batches(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def ingest_progress(batches: DataFrame, output: DataFrame, listing: DataFrame) -> DataFrame:
    """Running progress of a file ingest at the end of each of its batches, per run.

    ``batches`` are the rows of a ``BatchLog``, ``output`` has the ``batch_id`` and ``source_file`` of every
    written row, ``listing`` the ``path`` and ``length`` of all files. Files without any row are
    no work and count for the total only.
    """

    def plain(path):
        return F.regexp_replace(path, "^file:/+", "/")

    # Spark's own input count counts a row again for every time that the batch is read, so written rows are counted.
    read = output.groupBy("batch_id", plain(F.col("source_file")).alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    sizes = listing.select(plain(F.col("path")).alias("path"), "length")
    per_batch = read.join(sizes, "path").groupBy("batch_id").agg(F.sum("length").alias("batch_bytes"), F.sum("rows").alias("written"))
    total = listing.agg(F.sum("length").alias("total_bytes")).scalar()
    # A run has as many rows as micro-batches.
    upto = Window.partitionBy("run_id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    running = batches.join(per_batch, "batch_id", "left").select(
        "run_id",
        "batch_id",
        F.sum(F.coalesce("written", F.lit(0))).over(upto).alias("processed_rows"),
        F.sum(F.coalesce("batch_bytes", F.lit(0))).over(upto).alias("processed_bytes"),
        total.alias("total_bytes"),
        F.sum("batch_ms").over(upto).alias("elapsed_ms"),
    )
    return progress_report(running)
