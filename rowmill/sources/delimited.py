"""Delimited text: header audit, structure check, typed scan, chunk files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions import text
from rowmill.sources import lines
from rowmill.spec import HEADER_PATTERNS

MAX_HEADER = 1000


def _split_pattern(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def cell_count(line: Column, sep: str = ",", quote: str = '"', naive: bool = False) -> Column:
    """Cells of a raw line; delimiters between quotes do not separate unless ``naive``."""
    body = line
    if not naive:
        # A quoted part, doubled quotes included, cannot hold a separator.
        body = F.regexp_replace(line, f"{quote}[^{quote}]*{quote}", "")
    return F.size(F.split(body, _split_pattern(sep), -1))


def header_names(line: Column, sep: str = ",") -> Column:
    """Column names of a header line: stripped, without the outer quote."""
    unquoted = F.transform(
        F.split(text.strip(line), _split_pattern(sep), -1),
        lambda x: F.regexp_replace(text.strip(x), r"""^["']|["']\z""", ""),
    )
    return unquoted


def lines_with_position(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Raw lines with their file and a position that grows within the file."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    return raw.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
    )


def header_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """First line of every file.

    Only the first block of a file counts, and the grouped minimum is folded per
    task, so nothing but headers is shuffled.
    """
    placed = lines_with_position(spark, path, recursive)
    return placed.filter(F.col("block_start") == 0).groupBy("file_path").agg(
        F.min_by("line", "seq").alias("header")
    )


def audit_headers(headers: DataFrame, required: Sequence[str] = ("id",), sep: str = ",") -> DataFrame:
    """Names and problems of every header; expects ``file_path`` and ``header``."""
    wanted = F.array(*[F.lit(c.lower().strip()) for c in required])
    named = headers.withColumn("columns", header_names(F.col("header"), sep)).withColumn(
        "normalized", F.transform("columns", lambda x: text.strip(F.lower(x)))
    )
    suspicious = F.filter(
        "columns", lambda x: x.rlike("|".join(f"(?:{p})" for p, _ in HEADER_PATTERNS))
    )
    # Every occurrence after the first one of a name.
    repeats = F.filter(
        F.transform(
            "normalized",
            lambda x, i: F.when(F.array_position(F.col("normalized"), x) < i + 1, x),
        ),
        lambda x: x.isNotNull(),
    )
    audited = named.withColumns(
        {
            "missing": F.array_except(wanted, F.col("normalized")),
            "duplicates": repeats,
            "suspicious": suspicious,
            "has_empty_name": F.exists("columns", lambda x: text.strip(x) == ""),
            "is_empty": text.strip(F.col("header")) == "",
            "is_too_long": text.unit_length(F.col("header")) > MAX_HEADER,
        }
    )
    fine = (
        (F.size("missing") == 0)
        & (F.size("duplicates") == 0)
        & (F.size("suspicious") == 0)
        & ~F.col("has_empty_name")
        & ~F.col("is_empty")
        & ~F.col("is_too_long")
    )
    return audited.withColumn("is_valid", fine)


def column_positions(audited: DataFrame) -> DataFrame:
    """Position of each name per file; of a repeated name the last one."""
    return (
        audited.select("file_path", F.posexplode("normalized").alias("position", "name"))
        .groupBy("file_path", "name")
        .agg(F.max("position").alias("position"), F.count(F.lit(1)).alias("occurrences"))
    )


def check_structure(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    naive: bool = False,
    audited: DataFrame | None = None,
) -> DataFrame:
    """Per file: expected cells, data lines and lines with another cell count.

    All lines are checked, folded per task before the shuffle.
    """
    placed = lines_with_position(spark, path)
    counted = placed.withColumn("cells", cell_count(F.col("line"), sep, naive=naive))
    headers = header_lines(spark, path) if audited is None else audited.select("file_path", "header")
    expected = headers.select("file_path", F.size(header_names(F.col("header"), sep)).alias("expected"))
    # One row per file and cell count: the join sees no single line.
    shapes = (
        counted.filter(text.strip(F.col("line")) != "")
        .groupBy("file_path", "cells")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    header_shape = headers.select(
        "file_path", cell_count(F.col("header"), sep, naive=naive).alias("cells"), F.lit(1).alias("header_line")
    )
    data = (
        shapes.join(header_shape, ["file_path", "cells"], "left")
        .withColumn("n", F.col("n") - F.coalesce("header_line", F.lit(0)))
        .join(expected, "file_path")
    )
    off = F.col("cells") != F.col("expected")
    return data.groupBy("file_path").agg(
        F.max("expected").alias("expected"),
        F.sum("n").alias("data_lines"),
        F.coalesce(F.sum(F.when(off, F.col("n"))), F.lit(0)).alias("bad_lines"),
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    quote: str = '"',
    escape: str = '"',
    encoding: str = "UTF-8",
    multi_line: bool = False,
    max_cell: int = -1,
    max_rows: int | None = None,
    numbered: bool = True,
    ragged: bool = True,
    recursive: bool = True,
    places: bool = False,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Rows of text cells with ``source_file`` and, when asked, ``row_number``.

    An empty cell is the empty string; a cell that a short line does not have is
    null. Every file is read by its own header, and files meet by column name, so
    their columns may stand in any order; a column that a file does not have is null.
    All headers are read in one scan. With ``columns`` all files are taken to have these, in this order. Of a
    repeated name the last column is kept.
    ``ragged=False`` skips the handling of short lines and reads them as empty
    cells. ``multi_line`` allows line ends inside quotes and makes files
    unsplittable; it, and encodings other than UTF-8, need ``columns``.
    ``places`` adds ``byte_offset`` of the row in its file and its ``raw_line`` without the line end.
    ``blocks`` may give the files' ``lines.block_table`` if it is there already.
    """
    if columns is None:
        if multi_line or encoding.upper() != "UTF-8":
            raise ValueError("line ends inside quotes and other encodings need the columns")
        rows = _read_by_headers(spark, path, sep, quote, escape, max_cell, ragged, recursive, places, blocks)
        if not numbered and max_rows is None:
            return rows.drop("row_number")
    else:
        if places:
            raise ValueError("places are for files that are read by their headers")
        how = {"sep": sep, "quote": quote, "escape": escape, "encoding": encoding, "multi_line": multi_line}
        rows = _read_cells(spark, path, list(columns), **how, max_cell=max_cell, ragged=ragged, recursive=recursive)
        if not numbered and max_rows is None:
            return rows.drop("__block", "__seq")
        rows = _number(rows)
    return rows if max_rows is None else rows.filter(F.col("row_number") <= max_rows)


def _names(header: Column, sep: str) -> Column:
    return F.transform(header_names(lines.without_end(header), sep), lambda x: text.strip(F.lower(x)))


def _read_by_headers(
    spark: SparkSession,
    path: str,
    sep: str,
    quote: str,
    escape: str,
    max_cell: int,
    ragged: bool,
    recursive: bool,
    places: bool,
    blocks: DataFrame | None,
) -> DataFrame:
    """Every line parsed into a list of cells, and columns taken from it by the header of the line's file.

    The driver gets the distinct column names, which are the columns of the result.
    """
    blocks = lines.block_table(spark, path, recursive) if blocks is None else blocks
    headers = blocks.where("header IS NOT NULL").groupBy("header").agg(F.min("source_file").alias("first"))
    named = headers.select("first", F.posexplode(_names(F.col("header"), sep)).alias("position", "name"))
    firsts = named.groupBy("name").agg(F.min(F.struct("first", "position")).alias("at"), F.max("position").alias("last"))
    found = firsts.orderBy("at").collect()
    if not found:
        raise ValueError(f"no header found under {path}")
    width = 1 + max(row["last"] for row in found)
    own = F.reverse(_names(F.col("header"), sep))
    # Place of each column in the file's lines, of a repeated name the last; null if the file does not have it.
    spots = [F.nullif(F.array_position(own, row["name"]), F.lit(0).cast("bigint")) for row in found]
    placed = blocks.withColumn("__places", F.array(*[(F.size(own) - spot).cast("int") for spot in spots])).drop("header")
    rows = lines.numbered_lines(spark, path, placed, recursive, places)

    options = {"sep": sep, "quote": quote, "escape": escape, "emptyValue": "", "mode": "PERMISSIVE"}
    options["maxCharsPerColumn"] = str(max_cell)
    fields = [f"c{i}" for i in range(width)]
    raw = lines.without_end(F.col("line"))
    parsed = rows.withColumn("raw_line", raw).withColumn(
        "__cells", F.from_csv(F.col("raw_line"), ", ".join(f"{c} string" for c in fields), options)
    )
    listed = parsed.withColumn("__cells", F.array(*[F.col("__cells")[c] for c in fields]))
    if ragged:
        listed = listed.withColumn("__present", cell_count(F.col("raw_line"), sep, quote))

    def cell(i: int, name: str) -> Column:
        spot = F.get(F.col("__places"), F.lit(i))
        value = F.coalesce(F.get(F.col("__cells"), spot), F.lit(""))
        return F.when(F.col("__present") > spot if ragged else spot.isNotNull(), value).alias(name)

    more = ["byte_offset", "raw_line"] if places else []
    return listed.select(*[cell(i, row["name"]) for i, row in enumerate(found)], "source_file", "row_number", *more)


def _read_cells(
    spark: SparkSession,
    path: str | list[str],
    names: list[str],
    sep: str,
    quote: str,
    escape: str,
    encoding: str,
    multi_line: bool,
    max_cell: int,
    ragged: bool,
    recursive: bool,
) -> DataFrame:
    """Cells of files with one header, their file, block and sequence."""
    last = {name: i for i, name in enumerate(names)}
    unique = [name if last[name] == i else f"__{i}_{name}" for i, name in enumerate(names)]
    fields = [T.StructField(name, T.StringType()) for name in unique]
    if ragged:
        fields.append(T.StructField("__raw", T.StringType()))
    reader = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("sep", sep)
        .option("quote", quote)
        .option("escape", escape)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("emptyValue", "")
        .option("maxCharsPerColumn", max_cell)
        .option("recursiveFileLookup", str(recursive).lower())
    )
    if ragged:
        reader = reader.option("columnNameOfCorruptRecord", "__raw")
    raw = reader.csv(path)
    present = cell_count(F.col("__raw"), sep, quote) if ragged else None

    def cell(i: int, name: str) -> Column:
        if not ragged:
            return F.coalesce(F.col(name), F.lit("")).alias(name)
        has = F.col("__raw").isNull() | (present > i)
        return F.when(has, F.coalesce(F.col(name), F.lit(""))).alias(name)

    cells = [cell(i, name) for i, name in enumerate(unique) if not name.startswith("__")]
    return raw.select(
        *cells,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
    )


def _number(rows: DataFrame) -> DataFrame:
    """Dense row number over all files, in path, block and line order.

    The rows of one file block are consecutive in their task, so a row's place
    in the block is its task sequence minus the block's first. Block sizes come
    from a counting pass that reads no cells; only that table, with one row per
    block (about 800,000 for 100 TB), is ordered, in one task. No window ever runs
    over the rows; Spark picks the join with the block table by its measured size.
    """
    blocks = rows.groupBy("source_file", "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first")
    )
    in_order = Window.partitionBy(F.lit(0)).orderBy("source_file", "__block")
    offsets = blocks.select(
        "source_file",
        "__block",
        "__first",
        F.coalesce(F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "__before"
        ),
    )
    joined = rows.join(offsets, ["source_file", "__block"])
    number = F.col("__before") + F.col("__seq") - F.col("__first") + 1
    return joined.withColumn("row_number", number.cast("bigint")).drop("__block", "__seq", "__first", "__before")


def write_delimited(df: DataFrame, path: str, sep: str = ",", files: int | None = None) -> None:
    """Text files with a header, every cell quoted, quotes doubled, null as empty."""
    out = df if files is None else df.coalesce(files)
    _text_writer(out.select(*_filled(out.columns)), sep).csv(path)


def _filled(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def _text_writer(df: DataFrame, sep: str = ","):
    return (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("sep", sep)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_partitioned(df: DataFrame, path: str, by: str, sep: str = ",") -> None:
    """The same files in one folder per value of a column."""
    cells = _filled([c for c in df.columns if c != by])
    _text_writer(df.select(by, *cells), sep).partitionBy(by).csv(path)


def write_chunks(
    assigned: DataFrame, path: str, format: str = "csv", key: str = "id", files_per_chunk: int = 1
) -> None:
    """One folder per chunk, rows without a chunk left out.

    ``files_per_chunk`` spreads a chunk over several tasks, by a hash of the
    key, when chunks are larger than a task should write.
    """
    rows = assigned.filter(F.col("chunk_index").isNotNull())
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_chunk))
    parted = rows.repartition("chunk_index", spread) if files_per_chunk > 1 else rows.repartition("chunk_index")
    if format == "csv":
        write_partitioned(parted, path, "chunk_index")
    elif format == "parquet":
        parted.write.mode("errorifexists").partitionBy("chunk_index").parquet(path)
    else:
        raise ValueError("format must be 'csv' or 'parquet'")
