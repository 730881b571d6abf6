"""Embedding near-duplicates: dual traversal of cover trees, all pairs at or over a cosine.

Vectors of one label are points on the unit sphere, where a cosine of ``c`` is a
distance of ``sqrt(2 - 2c)``. Equal vectors become one point with a weight. The upper
tree is built by Spark: a node with more points than a block is split by centres
that lie more than half its radius apart, taken from a bounded hash sample of its points; every point goes to
its nearest centre, and the covering radius of each child is its largest distance. Node pairs
start at (label, label); children of a pair are met and dropped when the distance of their centres
exceeds both covering radii plus the threshold distance. A node that cannot be split is dealt into blocks.

Each surviving pair of blocks is one group: both sides get a local cover tree, nested levels
with halving radii, and pairs of nodes are pruned level by level by the same bound, down to points,
whose cosine is then computed in double precision. A group returns
link counts and local components, not pairs.

Vectors that are null, empty, zero or have null or non-finite components, and rows
with a null label, link with nothing. Vectors of different length have cosine only with
their own length. Rows with equal ids are one vertex of the components and have a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.components import connected_components
from rowmill.llm.stored import Scratch

BLOCK = 2048
FANOUT = 32
MOST_LEVELS = 12
SLACK = 1e-9


def spread(centres: np.ndarray, least: float) -> np.ndarray:
    """Rows that lie more than ``least`` from all earlier kept rows."""
    kept: list[int] = []
    for i, c in enumerate(centres):
        if not kept or np.min(np.linalg.norm(centres[kept] - c, axis=1)) > least:
            kept.append(i)
    return centres[kept]


class Level:
    """Nodes of one level: a centre's point number, exact covering radius, parent, and the node of every point."""

    def __init__(self, centre: np.ndarray, radius: np.ndarray, parent: np.ndarray, node_of: np.ndarray):
        self.centre, self.radius, self.parent, self.node_of = centre, radius, parent, node_of


def cover_tree(points: np.ndarray, least: float) -> list[Level]:
    """Nested levels with halving radii down to ``least``; a centre stays a centre on all lower levels.

    The distances of all points, at most a block of them, are one product, from which every level picks its nodes;
    radii are computed from the points.
    """
    n = len(points)
    between = distances(points, points)
    np.fill_diagonal(between, 0.0)
    away = between[0]
    levels = [Level(np.zeros(1, int), np.array([away.max()]), np.zeros(1, int), np.zeros(n, int))]
    bound = away.max() / 2
    while bound > least and levels[-1].radius.max() > 0:
        centre, parent, node_of = [], [], np.empty(n, int)
        for k, c in enumerate(levels[-1].centre):
            rest = np.flatnonzero(levels[-1].node_of == k) if levels[-1].radius[k] > 0 else np.array([c])
            while len(rest):
                near = (between[c, rest] <= bound) | (rest == c)
                node_of[rest[near]] = len(centre)
                centre.append(c)
                parent.append(k)
                rest = rest[~near]
                c = rest[0] if len(rest) else c
        centre, radius = np.array(centre), np.zeros(len(centre))
        np.maximum.at(radius, node_of, np.linalg.norm(points - points[centre[node_of]], axis=1))
        levels.append(Level(centre, radius, np.array(parent), node_of))
        bound /= 2
    return levels


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def dual_links(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which points of ``a`` and ``b`` (raw vectors) are at or over the cosine; a block against itself has one tree."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    unit_a, unit_b = a / norm_a[:, None], b / norm_b[:, None]
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK + 1e-7
    tree_a = cover_tree(unit_a, reach / 4)
    tree_b = tree_a if a is b else cover_tree(unit_b, reach / 4)
    alive = np.ones((1, 1), bool)
    for step in range(max(len(tree_a), len(tree_b))):
        x, y = tree_a[min(step, len(tree_a) - 1)], tree_b[min(step, len(tree_b) - 1)]
        if step:
            up_x = x.parent if step < len(tree_a) else np.arange(len(x.centre))
            up_y = y.parent if step < len(tree_b) else np.arange(len(y.centre))
            alive = alive[np.ix_(up_x, up_y)]
        if not alive.any():
            return np.zeros((len(a), len(b)), bool)
        alive &= distances(unit_a[x.centre], unit_b[y.centre]) <= x.radius[:, None] + y.radius[None] + reach
    met = alive[np.ix_(tree_a[-1].node_of, tree_b[-1].node_of)]
    links = np.zeros((len(a), len(b)), bool)
    rows, columns = np.flatnonzero(met.any(1)), np.flatnonzero(met.any(0))
    if len(rows):
        cosines = (a[rows] @ b[columns].T) / (norm_a[rows, None] * norm_b[columns][None])
        links[np.ix_(rows, columns)] = met[np.ix_(rows, columns)] & (cosines >= cosine)
    return links


def block_links(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Link counts and a local root of every point of a block pair that has links."""
    same = bool(group["same"].iloc[0])
    sides = [group] if same else [group[group["side"] == s] for s in (0, 1)]
    empty = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    if any(not len(s) for s in sides):
        return empty
    points = [np.array(s["vector"].tolist(), float) for s in sides]
    links = dual_links(points[0], points[-1], cosine)
    if same:
        np.fill_diagonal(links, False)
    ids, weights = ([s[c].to_numpy(np.int64) for s in sides] for c in ("id", "weight"))
    rows, columns = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(rows):
        return empty
    links = links[np.ix_(rows, columns)]
    row_ids, column_ids = ids[0][rows], ids[-1][columns]
    row_root, column_root = row_ids.copy(), column_ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_row = np.minimum(row_root, np.where(links, column_root[None], top).min(1))
        new_column = np.minimum(column_root, np.where(links, new_row[:, None], top).min(0))
        if (new_row == row_root).all() and (new_column == column_root).all():
            break
        row_root, column_root = new_row, new_column
    out = [pd.DataFrame({"id": row_ids, "links": links @ weights[-1][columns], "root": row_root})]
    if not same:
        out.append(pd.DataFrame({"id": column_ids, "links": weights[0][rows] @ links, "root": column_root}))
    return pd.concat(out)


def _nearest(rows: DataFrame, unit_col: str = "vector") -> DataFrame:
    """Adds ``child`` and ``away``: the nearest of ``centres`` (rows without centres keep child 0)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            child, away = [], []
            vectors, centres = batch.column("vector"), batch.column("centres")
            at, upto = vectors.offsets.to_numpy().tolist(), centres.offsets.to_numpy().tolist()
            values, listed = vectors.values.to_numpy(), centres.values
            inner, flat = listed.offsets.to_numpy().tolist(), listed.values.to_numpy()
            for a, b, first, end in zip(at, at[1:], upto, upto[1:]):
                v = values[a:b]
                own = flat[inner[first] : inner[end]].reshape(end - first, b - a)
                far = np.linalg.norm(own - v / np.linalg.norm(v), axis=1)
                child.append(int(far.argmin()))
                away.append(float(far.min()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "weight", "vector", "node")), pa.array(child, pa.int32()), pa.array(away, pa.float64())],
                ["id", "weight", "vector", "node", "child", "away"],
            )

    return rows.select("id", "weight", "vector", "node", "centres").mapInArrow(
        assign, "id long, weight long, vector array<double>, node string, child int, away double"
    )


def split_nodes(points: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of the nodes, one level down, and the centres of the new nodes (``parent``, ``node``, ``centre``)."""
    wanted = F.least(F.lit(FANOUT), F.ceil(2 * F.col("n") / BLOCK)).cast("int")
    sample = points.join(nodes.select("node", "n", "radius", wanted.alias("wanted")), "node")
    # About four times as many points as centres are wanted, by hash; a node always has some.
    sample = sample.where(F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < 4 * F.col("wanted") + 8)
    order = Window.partitionBy("node").orderBy(F.xxhash64("id", F.lit(7)), "id")
    sample = sample.withColumn("place", F.row_number().over(order)).where("place <= 4 * wanted + 8")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        vectors = np.array(group["vector"].tolist(), float)
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        most, least = int(group["wanted"].iloc[0]), float(group["radius"].iloc[0]) / 2
        centres = spread(unit, least)
        if len(centres) < 2:
            centres = unit
        return pd.DataFrame({"node": [group["node"].iloc[0]], "centres": [centres[:most].tolist()]})

    centres = sample.select("node", "place", "wanted", "radius", "vector").groupBy("node").applyInPandas(
        choose, "node string, centres array<array<double>>"
    )
    down = _nearest(points.join(centres, "node"))
    name = F.concat_ws(".", F.col("node"), F.col("child").cast("string"))
    made = centres.select("node", F.posexplode("centres").alias("child", "centre"))
    return (
        down.select("id", "weight", "vector", F.col("node").alias("parent"), name.alias("node"), "away"),
        made.select(F.col("node").alias("parent"), name.alias("node"), "centre"),
    )


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept`` (the vector with the smallest id of its component)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cover-tree")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").select("id", "vector", F.concat_ws("|", "label", F.size("vector").cast("string")).alias("node"))
    folded = scratch.store(good.groupBy("node", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight")))
    # Points are numbered by their first id and node: one id may stand in rows of different labels.
    points = folded.select(F.col("first").alias("id"), "weight", "vector", "node", F.col("node").alias("parent"), F.lit(2.0).alias("away"))
    nodes = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    root_centre = folded.groupBy("node").agg(F.min_by("vector", "first").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    nodes = nodes.join(root_centre.select("node", F.transform("v", lambda x: x / norm).alias("centre")), "node")
    nodes = scratch.store(nodes)
    pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    done = None
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK + 1e-7
    for _ in range(MOST_LEVELS):
        large = nodes.where(F.col("n") > BLOCK)
        if large.isEmpty():
            break
        lower, made = split_nodes(points.join(large.select("node"), "node").select("id", "weight", "vector", "node"), large)
        lower, made = scratch.store(lower), scratch.store(made)
        small = points.join(large.select("node"), "node", "left_anti").select("id", "weight", "vector", "parent", "node", "away")
        done = small if done is None else done.union(small)
        below = lower.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).join(made, "node")
        below = scratch.store(below)
        # Nodes that were not split meet the new ones as their own children.
        kept = nodes.where(F.col("n") <= BLOCK).select("node", "n", "radius", F.col("node").alias("parent"), "centre")
        children = kept.union(below.select("node", "n", "radius", "parent", "centre"))
        side = lambda c: children.select(F.col("parent").alias(c), F.col("node").alias(f"{c}_node"), F.col("radius").alias(f"{c}_radius"), F.col("centre").alias(f"{c}_centre"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").where("a != b OR a_node <= b_node")
        gap = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        near = (F.col("a_node") == F.col("b_node")) | (gap <= F.col("a_radius") + F.col("b_radius") + reach)
        pairs = scratch.store(met.where(near).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
        nodes = scratch.store(children.select("node", "n", "radius", "centre"))
        points = lower
    points = points.select("id", "weight", "vector", "node") if done is None else points.select("id", "weight", "vector", "node").union(done.select("id", "weight", "vector", "node"))

    # A node that is still larger than a block is dealt into blocks, every two of which meet.
    blocks = nodes.select("node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = points.join(blocks, "node").select("id", "weight", "vector", F.concat_ws("#", "node", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("string")).alias("block"))
    parts = blocks.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    of = lambda c: parts.select(F.col("node").alias(c), F.concat_ws("#", "node", F.col("part").cast("string")).alias(f"{c}_block"))
    block_pairs = scratch.store(
        pairs.join(of("a"), "a").join(of("b"), "b").where("a != b OR a_block <= b_block").select("a_block", "b_block", (F.col("a_block") == F.col("b_block")).alias("same"))
    )
    left = placed.join(block_pairs.withColumnRenamed("a_block", "block"), "block").select("block", "b_block", "same", F.lit(0).alias("side"), "id", "weight", "vector")
    right = placed.join(block_pairs.where("NOT same").withColumnRenamed("b_block", "block"), "block").select(
        F.col("a_block").alias("block"), F.col("block").alias("b_block"), "same", F.lit(1).alias("side"), "id", "weight", "vector"
    )
    found = left.union(right).groupBy("block", "b_block").applyInPandas(lambda group: block_links(group, cosine), "id long, links long, root long")
    found = scratch.store(found)

    members = scratch.store(good.join(folded, ["node", "vector"]).select("id", "first", "node", "weight"))
    edges = found.select(F.col("id").alias("u"), F.col("root").alias("v")).union(members.select(F.col("id").alias("u"), F.col("first").alias("v")))
    known = connected_components(edges, scratch)
    links = found.groupBy(F.col("id").alias("first")).agg(F.sum("links").alias("links"))
    counted = members.join(links, "first", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    others = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"))
    out = counted.union(others).join(known, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_links", F.coalesce("component", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )
