"""Ordered calculations per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in a single task,
which fails when one key holds a large share of the table. Here every key is
cut into slices of its order (row-number blocks or time spans). The window runs
inside (key, slice); what a slice needs from the earlier ones comes from a
summary with one row per (key, slice), which is pre-aggregated before its
shuffle and therefore small even for the largest key.

``slice_col`` must grow with the order: all rows of slice 3 come before those
of slice 4. Key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.numbers import floor_div

ROWS_PER_SLICE = 1_000_000


def row_slice(row_number: Column, width: int = ROWS_PER_SLICE) -> Column:
    """Slice of a unique row number: holds at most ``width`` rows of any key."""
    return floor_div(row_number, width)


def _local(keys: Sequence[str], slice_col: str, order_by: Sequence[Column | str]):
    return Window.partitionBy(*keys, slice_col).orderBy(*order_by)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order_by: Sequence[Column | str],
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key in the given order."""
    slice_sums = df.groupBy(*keys, slice_col).agg(
        *[F.sum(value).alias(f"__{name}_in") for name, value in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_sums.select(
        *keys,
        slice_col,
        *[F.coalesce(F.sum(f"__{name}_in").over(before), F.lit(0)).alias(f"__{name}_before") for name in sums],
    )
    upto = _local(keys, slice_col, order_by).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumns({f"__{name}": F.sum(value).over(upto) for name, value in sums.items()})
    joined = within.join(offsets, [*keys, slice_col], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__{name}") + F.col(f"__{name}_before")).alias(name) for name in sums],
    )


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order_by: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """Add the value of the preceding row per key; ``values`` maps new name to column."""
    position = F.struct(*[F.col(c) for c in order_by])
    last = df.groupBy(*keys, slice_col).agg(
        *[F.max_by(F.struct(F.col(c).alias("v")), position).alias(f"__{name}_last") for name, c in values.items()]
    )
    by_slice = Window.partitionBy(*keys).orderBy(slice_col)
    carried = last.select(
        *keys,
        slice_col,
        *[F.lag(f"__{name}_last").over(by_slice)["v"].alias(f"__{name}_carry") for name in values],
    )
    local = _local(keys, slice_col, order_by)
    within = df.withColumns(
        {
            "__pos": F.row_number().over(local),
            **{f"__{name}": F.lag(c).over(local) for name, c in values.items()},
        }
    )
    joined = within.join(carried, [*keys, slice_col], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            F.when(F.col("__pos") == 1, F.col(f"__{name}_carry")).otherwise(F.col(f"__{name}")).alias(name)
            for name in values
        ],
    )
