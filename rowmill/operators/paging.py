"""Filtered lists, sort orders and pages."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# List order of action statuses; any other status comes after.
STATUS_PRIORITY = ("processing", "queued", "failed")


def check_page(page: int, limit: int) -> None:
    if page < 1:
        raise ValueError("Page must be at least 1")
    if not 1 <= limit <= 100:
        raise ValueError("Limit must be between 1 and 100")


def where_equal(df: DataFrame, filters: Mapping[str, Any], renames: Mapping[str, str] | None = None) -> DataFrame:
    """Rows that equal every given value; ``None`` and unknown fields are ignored.

    Plain comparisons, so the filters reach the Parquet scan.
    """
    renames = renames or {}
    for name, value in filters.items():
        column = renames.get(name, name)
        if value is not None and column in df.columns:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def search_contacts(df: DataFrame, search: str | None = None, email: str | None = None, **filters) -> DataFrame:
    """Substring search over name or email without regard to case, exact email filter."""
    if email:
        df = df.filter(F.col("email") == email.lower())
    if search:
        pattern = f"%{search}%"
        df = df.filter(F.col("name").ilike(pattern) | F.col("email").ilike(pattern))
    return where_equal(df, filters)


def newest_first(key: str = "id", created: str = "created_at") -> list[Column]:
    return [F.desc(created), F.asc(key)]


def priority(status: Column) -> Column:
    rank = F.lit(len(STATUS_PRIORITY) + 1)
    for position, name in reversed(list(enumerate(STATUS_PRIORITY, start=1))):
        rank = F.when(status == name, F.lit(position)).otherwise(rank)
    return rank


def by_priority(key: str = "id", created: str = "created_at", status: str = "status") -> list[Column]:
    """Processing, queued, failed, the rest; newest first within each."""
    return [priority(F.col(status)).asc(), *newest_first(key, created)]


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 10) -> DataFrame:
    """One page; Spark keeps only the top rows of each task for it."""
    check_page(number, limit)
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_after(
    df: DataFrame, last_created: Any, last_key: Any, limit: int = 10, key: str = "id", created: str = "created_at"
) -> DataFrame:
    """The page after a given row, newest first; cost does not grow with depth."""
    check_page(1, limit)
    instant, anchor = F.lit(last_created), F.lit(last_key)
    later = (F.col(created) < instant) | ((F.col(created) == instant) & (F.col(key) > anchor))
    return df.filter(later).orderBy(*newest_first(key, created)).limit(limit)


def page_meta(df: DataFrame, number: int = 1, limit: int = 10) -> DataFrame:
    """Total, page count and whether there is a next or previous page."""
    check_page(number, limit)
    pages = F.ceil(F.col("total") / F.lit(limit)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(number).alias("page"),
        F.lit(limit).alias("limit"),
        "total",
        pages.alias("total_pages"),
        (F.lit(number) < pages).alias("has_next"),
        F.lit(number > 1).alias("has_prev"),
    )
