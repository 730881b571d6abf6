"""Connected components of a graph by alternating large-star and small-star steps.

Each step is a minimum per vertex, folded before its shuffle, joined back to the
edges. No vertex's neighbours are gathered; the join on a hot vertex has one row on its
other side, so Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.stored import Scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every vertex of ``edges`` (u, v)."""
    now = scratch.store(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        around = _both_ways(now)
        least = _least(around).select("u", F.least("m", "u").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = large.join(_least(large), "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        stars = scratch.store(after.where("u != v").distinct())
        scratch.drop(now)
        now, before = stars, mark
        mark = _mark(now)
        if mark == before:
            break
    return scratch.store(
        now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    )
