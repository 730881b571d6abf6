"""Duplicate handling by a normalised key.

Two families, because their cost differs:

* *survivors* (keep first or last, merge): grouped aggregates with ``min_by`` /
  ``max_by``. Every task folds its rows of a key before the shuffle, so a key
  that holds a third of the table sends one row per task.
* *verdicts* (one row out per row in): running numbers per key, computed in
  slices of the row number, see ``rowmill.functions.ordered``.

Rows without a key are never duplicates of anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions import text
from rowmill.functions.numbers import percent
from rowmill.functions.ordered import ROWS_PER_SLICE, row_slice
from rowmill.session import scratch_dir

STRATEGIES = ("keep_first", "keep_last", "mark_all", "merge_data")


def normalize_key(
    c: Column, trim: bool = True, ignore_case: bool = True, collapse: bool = True
) -> Column:
    """Comparable form of a key; null and the empty string give null (no key)."""
    key = c.cast("string")
    if collapse:
        # Covers the other two: only blanks are left to trim after the collapse.
        out = F.lower(F.trim(text.collapse_space(key)))
    else:
        out = text.strip(key) if trim else key
        out = F.lower(out) if ignore_case else out
    return F.when(~text.is_blank(key), out)


def _check(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")


def _with_group(df: DataFrame, key: Column, long_keys: bool) -> DataFrame:
    # Long keys (whole texts) are grouped by their SHA-256 to keep the shuffle narrow.
    group = F.unhex(F.sha2(key, 256)) if long_keys else key
    return df.withColumn("__key", group)


def one_per_key(
    df: DataFrame, key: Column, order: str = "row_number", last: bool = False, long_keys: bool = False
) -> DataFrame:
    """First (or last) row of every key, plus all rows without a key.

    Row numbers and keys are taken in one scan, written, and folded by key in a hash aggregate. The numbers of
    the other rows of repeated keys are written too; the rows only lose those, so Spark moves no row if they are
    few, and rows without a key or with a key of their own need no look at it.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "one-per-key")
    pick = F.max if last else F.min
    taken = _with_group(df, key, long_keys).filter(F.col("__key").isNotNull()).select(order, "__key")
    taken.write.parquet(f"{path}/keys")
    keyed = spark.read.schema(taken.schema).parquet(f"{path}/keys")
    losers = _losing_rows(keyed, order, pick)
    losers.write.parquet(f"{path}/losers")
    return df.join(spark.read.schema(losers.schema).parquet(f"{path}/losers"), order, "left_anti").select(df.columns)


def _losing_rows(keyed: DataFrame, order: str, pick: Callable[[str], Column]) -> DataFrame:
    """Numbers of the rows that are not the one of their ``__key`` that ``pick`` takes."""
    winners = keyed.groupBy("__key").agg(pick(order).alias(order))
    return keyed.select(order).join(winners.select(order), order, "left_anti")


def merge_per_key(
    df: DataFrame, key: Column, order: str = "row_number", prefer: str = "first", long_keys: bool = False
) -> DataFrame:
    """One row per key whose cells are the first (or last) non-empty ones of the group.

    The row number is that of the first occurrence; ``merged_rows`` counts the group.
    """
    if prefer not in ("first", "last"):
        raise ValueError("prefer must be 'first' or 'last'")
    pick = F.min_by if prefer == "first" else F.max_by
    tagged = _with_group(df, key, long_keys)
    own = F.when(F.col("__key").isNull(), F.col(order))
    cells = []
    for c, kind in df.dtypes:
        if c == order:
            continue
        filled = (F.col(c) != "") if kind == "string" else F.col(c).isNotNull()
        # Rows whose cell is empty get a null position, which min_by and max_by skip.
        cells.append(pick(F.col(c), F.when(filled, F.col(order))).alias(c))
    merged = tagged.groupBy("__key", own.alias("__own")).agg(
        F.min(order).alias(order), *cells, F.count(F.lit(1)).alias("merged_rows")
    )
    return merged.select(*df.columns, "merged_rows")


def key_counts(
    df: DataFrame, key: Column, order: str = "row_number", long_keys: bool = False
) -> DataFrame:
    """Occurrences, first and last row of every key; rows without a key are left out."""
    tagged = _with_group(df, key, long_keys).filter(F.col("__key").isNotNull())
    return tagged.groupBy("__key").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min(order).alias("first_row"),
        F.max(order).alias("last_row"),
    )


def surviving_rows(
    df: DataFrame, key: Column, order: str = "row_number", last: bool = False, long_keys: bool = False
) -> DataFrame:
    """Row number of the first (or last) row of every key: one shuffle of folded numbers.

    Rows without a key count as one group here; callers that keep all of them
    decide so by the key itself.
    """
    tagged = _with_group(df, key, long_keys)
    pick = F.max if last else F.min
    return tagged.groupBy("__key").agg(pick(order).alias(order)).select(order)


def number_duplicates(
    df: DataFrame,
    key: Column,
    order: str = "row_number",
    long_keys: bool = False,
    slice_rows: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``duplicate_count`` (running), ``first_occurrence`` and ``last_occurrence``.

    Rows without a key get 1 and nulls.
    """
    tagged = _with_group(df, key, long_keys).withColumns(
        {
            "__slice": row_slice(F.col(order), slice_rows),
            "__nokey": F.col("__key").isNull(),
        }
    )
    # The slice already bounds the group of rows without a key.
    blank = F.lit(b"") if long_keys else F.lit("")
    tagged = tagged.withColumn("__key", F.coalesce(F.col("__key"), blank))
    numbered = _running_with_bounds(tagged, order)
    own = F.col("__nokey")
    return numbered.select(
        *[F.col(c) for c in df.columns],
        F.when(own, F.lit(1)).otherwise(F.col("__seen")).cast("bigint").alias("duplicate_count"),
        F.when(~own, F.col("__first")).alias("first_occurrence"),
        F.when(~own, F.col("__last")).alias("last_occurrence"),
    )


def _running_with_bounds(tagged: DataFrame, order: str) -> DataFrame:
    keys = ["__key", "__nokey"]
    parts = tagged.groupBy(*keys, "__slice").agg(
        F.count(F.lit(1)).alias("__n"), F.min(order).alias("__lo"), F.max(order).alias("__hi")
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bounds = parts.select(
        *keys,
        "__slice",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.min("__lo").over(whole).alias("__first"),
        F.max("__hi").over(whole).alias("__last"),
    )
    local = Window.partitionBy(*keys, "__slice").orderBy(order)
    within = tagged.withColumn("__pos", F.row_number().over(local))
    joined = within.join(bounds, [*keys, "__slice"])
    return joined.withColumn("__seen", F.col("__pos") + F.col("__before"))


def mark_duplicates(
    df: DataFrame,
    key: Column,
    strategy: str = "keep_first",
    order: str = "row_number",
    enabled: bool = True,
    long_keys: bool = False,
    slice_rows: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``action`` (keep, skip or review) and the running duplicate numbers to every row."""
    _check(strategy)
    if not enabled:
        return df.withColumns(
            {
                "duplicate_count": F.lit(1).cast("bigint"),
                "first_occurrence": F.lit(None).cast("bigint"),
                "last_occurrence": F.lit(None).cast("bigint"),
                "action": F.lit("keep"),
            }
        )
    numbered = number_duplicates(df, key, order, long_keys, slice_rows)
    is_first = F.col("duplicate_count") == 1
    is_last = F.coalesce(F.col(order) == F.col("last_occurrence"), F.lit(True))
    if strategy == "keep_last":
        action = F.when(is_last, "keep").otherwise("skip")
    elif strategy == "mark_all":
        action = F.when(is_first, "keep").otherwise("review")
    else:
        action = F.when(is_first, "keep").otherwise("skip")
    return numbered.withColumn("action", action)


def deduplicate(
    df: DataFrame,
    key: Column,
    strategy: str = "keep_first",
    order: str = "row_number",
    enabled: bool = True,
    long_keys: bool = False,
) -> DataFrame:
    """Rows that flow on under a strategy, same columns as the input."""
    _check(strategy)
    if not enabled or strategy == "mark_all":
        return df
    if strategy == "merge_data":
        return merge_per_key(df, key, order, long_keys=long_keys).drop("merged_rows")
    return one_per_key(df, key, order, last=strategy == "keep_last", long_keys=long_keys)


def duplicate_report(
    df: DataFrame, key: Column, order: str = "row_number", top: int | None = None, long_keys: bool = False
) -> DataFrame:
    """Keys that occur more than once: first and last row and number of occurrences.

    ``top`` keeps the most frequent keys only; ties go to the key seen first.
    """
    repeated = key_counts(df, key, order, long_keys).filter(F.col("occurrences") > 1)
    if top is not None:
        repeated = repeated.orderBy(F.desc("occurrences"), "first_row").limit(top)
    return repeated.select("first_row", "last_row", "occurrences")


def duplicate_occurrences(
    df: DataFrame,
    key: Column,
    order: str = "row_number",
    top: int | None = None,
    long_keys: bool = False,
    slice_rows: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Every occurrence of the reported keys as a row: ``first_row`` of the key, row number, running number.

    Rows meet the repeated keys before they are numbered, so unique rows are
    neither windowed nor sorted. The keys are unique on their side of the join.
    """
    repeated = key_counts(df, key, order, long_keys).filter(F.col("occurrences") > 1)
    if top is not None:
        repeated = repeated.orderBy(F.desc("occurrences"), "first_row").limit(top)
    tagged = _with_group(df.select(order, *[c for c in df.columns if c != order]), key, long_keys)
    rows = tagged.select(order, "__key").join(repeated.select("__key", "first_row"), "__key")
    numbered = number_duplicates(rows.select(order, "first_row"), F.col("first_row"), order, False, slice_rows)
    return numbered.select("first_row", order, F.col("duplicate_count").alias("occurrence"))


def dedup_totals(
    df: DataFrame, key: Column, order: str = "row_number", long_keys: bool = False
) -> DataFrame:
    """Totals, duplicate rate and the histogram of occurrences, one row."""
    tagged = _with_group(df, key, long_keys)
    own = F.when(F.col("__key").isNull(), F.col(order))
    groups = tagged.groupBy("__key", own.alias("__own")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    totals = groups.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(n > 1).alias("duplicate_keys"),
        F.count_if(n == 2).alias("two_occurrences"),
        F.count_if(n.between(3, 5)).alias("three_to_five"),
        F.count_if(n > 5).alias("more_than_five"),
    )
    return totals.withColumn("skipped_rows", F.col("duplicate_rows")).withColumn(
        "duplicate_rate", percent(F.col("duplicate_rows"), F.col("total_rows"))
    )
