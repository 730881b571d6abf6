"""Files that arrive: the batch operators on a file stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rowmill.operators import chunking, dedup, validate
from rowmill.spec import CONTACTS, EntitySpec


def watch_delimited(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", max_files: int = 100
) -> DataFrame:
    """Stream of text rows of files as they arrive, with their file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("maxFilesPerTrigger", max_files)
        .csv(path)
    )
    return rows.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns],
        F.col("_metadata.file_path").alias("source_file"),
    )


def watch_parquet(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def write_batches(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the transformed rows of every micro-batch to its own folder.

    A batch that runs again after a failure overwrites its own folder, so each
    input row is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def ingest_files(
    stream: DataFrame,
    out_path: str,
    checkpoint: str,
    chunks: int = 1,
    order: str = "row_number",
    spec: EntitySpec = CONTACTS,
    dedup_key: str | None = "email",
    available_now: bool = True,
) -> StreamingQuery:
    """Validate, mark duplicates within each file and route every arriving file.

    The rows need an ``order`` cell (their number in the file); a file is one
    upload, so duplicates are looked for inside it only.
    """
    options = chunking.ChunkOptions(chunks=chunks, field=spec.key)

    def transform(batch: DataFrame) -> DataFrame:
        numbered = batch.withColumn(order, F.col(order).cast("bigint"))
        keep = (order, "source_file")
        checked = validate.validate(numbered, spec, keep=keep)
        if dedup_key is None:
            marked = checked.withColumn("action", F.when(F.col("is_valid"), "keep"))
        else:
            key = dedup.normalize_key(F.col(dedup_key))
            firsts = (
                checked.filter(F.col("is_valid") & key.isNotNull())
                .groupBy("source_file", key.alias("__key"))
                .agg(F.min(order).alias(order))
                .select("source_file", order, F.lit(True).alias("__first"))
            )
            stays = F.coalesce("__first", F.lit(False)) | key.isNull()
            marked = (
                checked.join(firsts, ["source_file", order], "left")
                .withColumn("action", F.when(F.col("is_valid"), F.when(stays, "keep").otherwise("skip")))
                .drop("__first")
            )
        index = chunking.ring.chunk_index(chunking.hash_key(F.col(spec.key)), options.chunks)
        flows = F.col("is_valid") & (F.col("action") != "skip")
        return marked.withColumn("chunk_index", F.when(flows, index))

    return write_batches(stream, transform, out_path, checkpoint, available_now)


def keep_first_stream(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of every key; a key is forgotten once the watermark passes it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
