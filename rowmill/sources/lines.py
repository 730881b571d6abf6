"""Lines of text files with their place in the file.

A first pass folds every file block to one row: its lines, its bytes and its first line.
That table, written once, gives each file its header and each block what lies
before it, in rows and in bytes. The second pass reads the lines and joins it, so every
byte is read twice, however many headers the files have. Lines end in ``\\n``; a ``\\r`` before
it belongs to the line end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmill.session import scratch_dir

KEY = ["source_file", "__block"]


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``source_file``, ``__block`` (its first byte), ``__length`` of the block, ``__size`` of the file, ``line`` with its ``\\r``."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.col("_metadata.file_block_length").alias("__length"),
        F.col("_metadata.file_size").alias("__size"),
        F.col("value").alias("line"),
    )


def is_filled(line: Column) -> Column:
    """Whether a line has more than blanks and control characters; others are no rows."""
    return line.rlike(r"[^\x00-\x20]")


def without_end(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)


def line_bytes(line: Column) -> Column:
    return (F.octet_length(line) + 1).cast("bigint")


def block_table(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One written row per file block: ``header`` of its file, rows and bytes before it, and how it was scanned.

    ``__first`` is the sequence number of the block's first filled line, ``__head`` marks the block with the header,
    ``__length`` is the block's size and ``__empty`` counts its lines that are no rows.
    """
    lines = scan(spark, path, recursive).withColumn("__seq", F.monotonically_increasing_id())
    filled = is_filled(F.col("line"))
    blocks = lines.groupBy(*KEY, "__length", "__size").agg(
        F.count_if(filled).alias("__n"),
        F.count(F.lit(1)).alias("__all"),
        F.sum(line_bytes(F.col("line"))).alias("__bytes"),
        F.min("__seq").alias("__at"),
        F.min_by("line", F.when(filled, F.col("__seq"))).alias("__line"),
    )
    # The second pass numbers the filled lines of a task only; a task reads its blocks one after the other.
    task = F.shiftright("__at", 33)
    earlier = Window.partitionBy(task).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.shiftleft(task, 33) + F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    return _placed(blocks.withColumn("__first", first), scratch_dir(spark, "blocks"))


def _placed(blocks: DataFrame, path: str) -> DataFrame:
    # One row per block, about 800,000 for 100 TB. The order over all files is cut per file first.
    inside = Window.partitionBy("source_file").orderBy("__block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_file")
    head = (F.col("__n") > 0) & (F.coalesce(F.sum("__n").over(before), F.lit(0)) == 0)
    blocks = blocks.withColumn("__head", head).withColumns(
        {
            "header": F.max(F.when(F.col("__head"), F.col("__line"))).over(whole),
            "__rows": F.col("__n") - F.col("__head").cast("int"),
            # A byte order mark is not part of the first line; the file is longer by it.
            "__mark": F.when((F.sum("__bytes").over(whole) - F.col("__size")).isin(-3, -2), 3).otherwise(0),
            "__bytes_before": F.coalesce(F.sum("__bytes").over(before), F.lit(0)),
        }
    )
    files = blocks.groupBy("source_file").agg(F.sum("__rows").alias("__file_rows"))
    over_files = Window.partitionBy(F.lit(0)).orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("__files_before", F.coalesce(F.sum("__file_rows").over(over_files), F.lit(0))).drop("__file_rows")
    out = blocks.join(files, "source_file").select(
        *KEY,
        "__length",
        (F.col("__all") - F.col("__n")).alias("__empty"),
        "__rows",
        "__first",
        "__head",
        "header",
        (F.col("__files_before") + F.coalesce(F.sum("__rows").over(before), F.lit(0))).cast("bigint").alias("__rows_before"),
        (F.col("__bytes_before") + F.col("__mark")).cast("bigint").alias("__bytes_before"),
    )
    out.write.parquet(path)
    return blocks.sparkSession.read.schema(out.schema).parquet(path)


def numbered_lines(spark: SparkSession, path: str, blocks: DataFrame, recursive: bool = True, places: bool = False) -> DataFrame:
    """Data lines with ``row_number`` over all files and the columns of their row in ``blocks``.

    With ``places`` also ``byte_offset`` of the line's first byte in its file. That
    needs the lengths of all lines before it in the block, so lines are dealt by block; without it they stay where they are read.
    """
    lines = scan(spark, path, recursive).drop("__size", "__length")
    if places:
        sequenced = lines.withColumn("__seq", F.monotonically_increasing_id())
        before = Window.partitionBy(*KEY).orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
        counted = sequenced.withColumns(
            {
                "__in_block": F.coalesce(F.sum(line_bytes(F.col("line"))).over(before), F.lit(0)),
                "__nth": F.coalesce(F.count_if(is_filled(F.col("line"))).over(before), F.lit(0)),
            }
        ).filter(is_filled(F.col("line")))
        rows = counted.join(blocks, KEY)
        nth = F.col("__nth")
        rows = rows.withColumn("byte_offset", (F.col("__bytes_before") + F.col("__in_block")).cast("bigint"))
    else:
        rows = lines.filter(is_filled(F.col("line"))).withColumn("__seq", F.monotonically_increasing_id())
        rows = rows.join(blocks, KEY, "left")
        same_task = F.shiftright(F.col("__seq"), 33) == F.shiftright(F.col("__first"), 33)
        nth = F.when(same_task, F.col("__seq") - F.col("__first")).otherwise(
            F.raise_error(F.lit("the files or the sizes of scan tasks have changed since the table was set up")).cast("bigint")
        )
    is_header = F.col("__head") & (F.col("__nth") == 0)
    kept = rows.withColumn("__nth", nth).filter(~is_header)
    number = F.col("__rows_before") + F.col("__nth") + F.when(F.col("__head"), 0).otherwise(1)
    return kept.withColumn("row_number", number.cast("bigint")).drop("__seq", "__nth", "__in_block")
