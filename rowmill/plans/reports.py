"""Read flows: action lists, action details and statistics."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.operators import merge, paging, stats
from rowmill.spec import ACTIONS


def list_actions(
    actions: DataFrame,
    page: int = 1,
    limit: int = 10,
    filters: Mapping[str, Any] | None = None,
    created_from: Any = None,
    created_to: Any = None,
) -> tuple[DataFrame, DataFrame]:
    """One page of actions in priority order, and its page data."""
    paging.check_page(page, limit)
    rows = paging.where_equal(actions, filters or {}, ACTIONS.renames)
    if created_from is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(created_from))
    if created_to is not None:
        rows = rows.filter(F.col("created_at") <= F.lit(created_to))
    return paging.page(rows, paging.by_priority(), page, limit), paging.page_meta(rows, page, limit)


def action_statistics(stats_table: DataFrame, action_id: str | None = None) -> DataFrame:
    """Counters and rates of one action or of all; the key filter reaches the scan."""
    return stats.rates(paging.where_equal(stats_table, {"action_id": action_id}))


def action_details(actions: DataFrame, stats_table: DataFrame, action_id: str | None = None) -> DataFrame:
    """Actions with their counters."""
    return merge.actions_with_stats(paging.where_equal(actions, {"id": action_id}), stats_table)
