"""Stored tables as folders of Parquet files.

Every state of a table is written to a path that the caller names and that does not
exist yet, so nothing is overwritten while it is read and a write that fails leaves the state before it.
Which state is current, and how writers take turns, is up to the caller or to a table format of Spark.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowmill.operators.paging import where_equal


def write_table(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Write a new state; rows sorted within files make key filters skip row groups."""
    out = df.sortWithinPartitions(sort_by) if sort_by else df
    out.write.mode("errorifexists").parquet(path)


def read_table(spark: SparkSession, path: str, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """A stored state, with equality filters that reach the scan."""
    return where_equal(spark.read.parquet(path), filters or {})
