"""N-gram Jaccard join by PartEnum signatures.

Two sets with Jaccard similarity of at least ``num/den`` differ in at most
``(den - num) * (|x| + |y|) / (den + num)`` elements. Sizes are cut into bands; a
set takes part in its own band and in the next one if a similar set may lie there.
In a band whose pairs differ in at most ``k`` elements, the feature domain is
dealt by hash into ``k + 1 + m`` partitions. As ``k`` elements touch at most ``k``
partitions, a similar pair has equal contents in at least ``m + 1`` of them, and
the content of each partition is one signature (first-level partitions with
one second-level subset each).

A partition is weak if it is empty or holds frequent shingles only. A set with at
most ``m`` weak partitions emits its strong signatures alone: one of the ``m + 1``
agreeing partitions is strong. A set with more is dealt anew with another hash,
``SEEDS`` times, and after the last also emits its weak signatures. A pair that
agrees in weak partitions only has more than ``m`` of them on both sides, so both
are dealt anew and the pair is met there: nothing is lost. Frequent shingles
come from a sample of documents and change the cost only, never the result.

Only the smallest id of each distinct text takes part in pairs; its copies are linked to it by their equal sets.
Pairs are verified as stars: members of a signature against one pivot, then, for
signatures whose members are not yet in one component, against a second one, and in
the end every pair of different components that shares a signature. A parity
sketch (one bit per hash bucket) bounds the number of different elements from below and
drops pairs that cannot be similar; the rest are compared on their exact shingles. A pair that shares
many signatures is asked for in the first of them.

Null texts and texts without words have an empty set and no link. Rows with
equal ids are one vertex and each has its row. Rows without an id link with
nothing and have no component. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.components import connected_components
from rowmill.llm.shingles import WIDTH, WordPrints, exact_shingles, mix, shingle_sets
from rowmill.llm.stored import Scratch
from rowmill.llm.words import in_slices, select_text, worker_memo

SEEDS = 3
BAND = 1.25
SPARE = 0.08
SALTS = 64
LARGE = 50_000
BLOCK = 1024
# Buckets a sketch has at most for the sake of a sharper bound, and signatures that a member of a block brings along.
FINE = 8192
EARLIER = 32


class Threshold:
    """Jaccard similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den

    def most_different(self, total):
        """Most elements in which a linked pair of sets with ``total`` elements together can differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    def linked(self, common: int, total: int) -> bool:
        return self.den * common >= self.num * (total - common)

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(band, largest size in it) of the bands in which a set of this size can have a larger partner."""
        largest, band, low = size * self.den // self.num, 0, 1
        out = []
        while low <= largest:
            high = max(low, math.ceil(low * BAND) - 1)
            if size <= high:
                out.append((band, high))
            band, low = band + 1, high + 1
        return out


def signatures(shingles: np.ndarray, threshold: Threshold, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strong and weak signatures of a set (see the module)."""
    strong, weak = [], []
    rare = np.ones(len(shingles), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rare = frequent[at] != shingles
    for band, high in threshold.bands(len(shingles)):
        k = int(threshold.most_different(2 * high))
        spare = 0 if k == 0 else 2 + math.ceil(SPARE * (k + 1))
        n = k + 1 + spare
        for seed in range(SEEDS):
            salt = np.uint64((band * SEEDS + seed) * 2 + 1)
            spread = mix(shingles + np.array([salt]) * np.uint64(0xD6E8FEB86659FD93))
            part = (spread % np.uint64(n)).astype(np.int64)
            content, again = np.zeros(n, np.uint64), mix(spread + salt)
            np.add.at(content, part, again)
            named = mix(content + mix(np.arange(n, dtype=np.uint64) + (salt << np.uint64(40))))
            solid = np.bincount(part[rare], minlength=n) > 0
            strong.append(named[solid])
            if n - solid.sum() <= spare:
                break
        else:
            weak.append(named[~solid])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return join(strong), join(weak)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """One bit per hash bucket, the parity of its elements.

    Buckets are a power of two: three to six times the elements up to ``FINE``, about as many as the elements beyond.
    """
    coarse, fine = (1 << max(6, n.bit_length()) for n in (len(shingles) * 7 // 10, len(shingles) * 3))
    bits = max(coarse, min(fine, FINE))
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with fewer buckets."""
    while sketch.shape[1] > size:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def different_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ."""
    x, y = (np.frombuffer(s, np.uint64)[None] for s in (a, b))
    size = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


SIGNATURE_BYTES = 6


def pack_signatures(sigs: np.ndarray) -> bytes:
    """The low bytes of signatures. Signatures that agree in them count as one, which only adds pairs to look at."""
    return np.ascontiguousarray(sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES]).tobytes()


def unpack_signatures(packed: bytes) -> np.ndarray:
    low = np.frombuffer(packed, np.uint8).reshape(-1, SIGNATURE_BYTES)
    return np.pad(low, ((0, 0), (0, 8 - SIGNATURE_BYTES))).view("<u8").ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as the first and the steps, four bytes each where they fit."""
    steps = np.diff(ids)
    if len(steps) and np.abs(steps).max() < 1 << 31:
        return ids[:1].astype("<i8").tobytes() + steps.astype("<i4").tobytes()
    return ids.astype("<i8").tobytes()


def unpack_ids(packed: bytes, n: int) -> np.ndarray:
    if len(packed) == 8 * n:
        return np.frombuffer(packed, "<i8")
    return np.cumsum(np.concatenate([np.frombuffer(packed[:8], "<i8"), np.frombuffer(packed[8:], "<i4").astype(np.int64)]))


def fingerprints(rows: DataFrame) -> DataFrame:
    """``id``, ``n`` (set size), ``digest`` of the set and ``sketch``, one row per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = worker_memo("word prints", WordPrints)
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), prints)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([parity_sketch(s) for s in sets], pa.binary()),
                ],
                ["id", "n", "digest", "sketch"],
            )

    return rows.mapInArrow(read, "id long, n long, digest binary, sketch binary")


def frequent_shingles(rows: DataFrame, every: int = 64, share: float = 0.001, least: int = 8, most: int = 200_000) -> np.ndarray:
    """Shingles in more than ``share`` of the documents (of a hash sample of one in ``every``), ``most`` at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = worker_memo("word prints", WordPrints)
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), prints)
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    docs = sample.count()
    counts = sample.mapInArrow(read, "shingle long").groupBy("shingle").count()
    found = counts.where(F.col("count") >= max(least, share * docs)).orderBy(F.desc("count"), "shingle").limit(most)
    return np.sort(np.array([r.shingle for r in found.collect()], np.int64).view(np.uint64))


def shared_signatures(rows: DataFrame, threshold: Threshold, frequent: np.ndarray, buckets: int) -> DataFrame:
    """``ids``, ``weak`` and ``sig``: the sets of documents that have a signature in common, each set once.

    Similar documents share many signatures, so most sets occur often and are kept once. Sets of weak
    signatures, and sets over ``LARGE``, come in salted parts that keep their signature ``sig``; a part
    may have one member. Signatures travel packed by bucket; equal texts in one task travel once.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, seen = worker_memo("word prints", WordPrints), set()
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), prints)
            sigs, ids, buckets_of, soft = [], [], [], []
            for i, s in zip(batch.column("id").to_pylist(), sets):
                if not len(s):
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(digest)
                strong, weak = signatures(s, threshold, frequent)
                own = np.concatenate([strong, weak])
                salted = np.concatenate([strong, mix(weak + np.uint64(i % SALTS + 1))])
                sigs.append(own)
                ids.append(np.full(len(own), i, np.int64))
                buckets_of.append((mix(salted) % np.uint64(buckets)).astype(np.int64))
                soft.append(np.repeat([False, True], [len(strong), len(weak)]))
            if not sigs:
                continue
            sig, id_, bucket, is_weak = map(np.concatenate, (sigs, ids, buckets_of, soft))
            order = np.argsort(bucket, kind="stable")
            sig, id_, bucket, is_weak = sig[order], id_[order], bucket[order], is_weak[order]
            used, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:], len(bucket)]
            cut = lambda pack, values: [pack(values[a:b]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array(cut(pack_signatures, sig), pa.binary()), pa.array(cut(pack_ids, id_), pa.binary()), pa.array(cut(np.ndarray.tobytes, is_weak), pa.binary())],
                ["bucket", "sigs", "ids", "weak"],
            )

    def meet(packed: pd.DataFrame) -> pd.DataFrame:
        sig = np.concatenate(list(map(unpack_signatures, packed["sigs"])))
        id_ = np.concatenate([unpack_ids(i, len(w)) for i, w in zip(packed["ids"], packed["weak"])])
        weak = np.frombuffer(b"".join(packed["weak"]), bool)
        order = np.lexsort((np.where(weak, id_ % SALTS, 0), sig)) if weak.any() else np.argsort(sig, kind="stable")
        sig, id_, weak = sig[order], id_[order], weak[order]
        salt = np.where(weak, id_ % SALTS, 0)
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(sig))
        used = np.flatnonzero((ends - starts > 1) | weak[starts])
        found: dict[bytes, None] = {}
        parts = []
        for a, b in zip(starts[used].tolist(), ends[used].tolist()):
            ids = np.unique(id_[a:b])
            if weak[a]:
                parts.append((sig[a], ids))
            elif len(ids) > LARGE:
                parts += [(sig[a], ids[k : k + LARGE]) for k in range(0, len(ids), LARGE)]
            elif len(ids) > 1:
                found[ids.tobytes()] = None
        rows = [(np.frombuffer(ids, np.int64), False, None) for ids in found]
        rows += [(ids, True, int(np.int64(np.uint64(s).view(np.int64)))) for s, ids in parts]
        out = pd.DataFrame(rows, columns=["ids", "weak", "sig"])
        return out.astype({"weak": bool, "sig": "Int64"})

    packed = rows.mapInArrow(sign, "bucket long, sigs binary, ids binary, weak binary")
    return packed.groupBy("bucket").applyInPandas(meet, "ids array<long>, weak boolean, sig long").distinct()


def verified(pairs: DataFrame, rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (``a``, ``b``) with whether their texts' exact shingle sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shingles = None, set()
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if y != last:
                    last, shingles = y, exact_shingles(y)
                own = exact_shingles(x)
                out.append(threshold.linked(len(own & shingles), len(own) + len(shingles)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    left = rows.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = rows.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean")


def possible(pairs: DataFrame, prints: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs whose sizes and sketches allow a link and whose sets are not known to be equal."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "limit"))
            fits = [different_at_least(x, y) <= most for x, y, most in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    side = lambda c: prints.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("digest").alias(f"digest_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    limit = F.floor((threshold.den - threshold.num) * (F.col("n_a") + F.col("n_b")) / (threshold.den + threshold.num))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where("digest_a != digest_b")
        .where(F.abs(F.col("n_a") - F.col("n_b")) <= limit)
        .select("a", "b", "sketch_a", "sketch_b", limit.cast("long").alias("limit"))
        .mapInArrow(bound, "a long, b long")
        .distinct()
    )


def open_pairs(members: DataFrame, prints: DataFrame, threshold: Threshold) -> DataFrame:
    """Possible pairs of different components in one signature, compared block by block."""
    return block_pairs(members, prints, threshold).distinct()


def block_pairs(members: DataFrame, prints: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs of ``open_pairs``, from the first signature that both members are known to share.

    Every member brings its first ``EARLIER`` signatures, so the blocks of later ones leave the pair out; where two share
    none of these, the pair may come more than once. Sketches join the members last, so they are shuffled once.
    """
    earlier = members.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, EARLIER).alias("earlier"))
    counts = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(counts, "sig").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def compare(sig: int, sides: list[list[tuple]], alone: bool) -> list[tuple[int, int]]:
        ids, components, sizes = ([np.array([row[c] for row in side], np.int64) for side in sides] for c in range(3))
        sketches = [[np.frombuffer(row[3], np.uint64)[None] for row in side] for side in sides]
        widths = [np.array([s.shape[1] for s in side]) for side in sketches]
        # Two sketches are compared at the width of the narrower one, whatever the others of the block have.
        folded = {}
        for width in np.unique(np.concatenate(widths)).tolist():
            folded[width] = [np.zeros((len(side), width), np.uint64) for side in sketches]
            for whole, side, own in zip(folded[width], sketches, widths):
                for k in np.flatnonzero(own >= width).tolist():
                    whole[k] = fold(side[k], width)[0]
        before: list[dict[int, frozenset]] = [{} for _ in sides]

        def met(side: int, k: int) -> frozenset:
            if k not in before[side]:
                known = sides[side][k][5]
                before[side][k] = frozenset(known[known < sig].tolist())
            return before[side][k]

        found = []
        for i, (own, component, size, width) in enumerate(zip(ids[0].tolist(), components[0], sizes[0], widths[0])):
            limit = (threshold.den - threshold.num) * (size + sizes[-1]) // (threshold.den + threshold.num)
            fits = (components[-1] != component) & (np.abs(sizes[-1] - size) <= limit)
            if alone:
                fits[: i + 1] = False
            at = np.flatnonzero(fits)
            shared = np.minimum(widths[-1][at], width)
            for w in np.unique(shared).tolist():
                near = at[shared == w]
                distance = np.bitwise_count(folded[w][-1][near] ^ folded[w][0][i]).sum(axis=1)
                for k in near[distance <= limit[near]].tolist():
                    if met(0, i).isdisjoint(met(-1, k)):
                        other = int(ids[-1][k])
                        found.append((max(own, other), min(own, other)))
        return found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so a block pair ends where the next begins; it has at most about two blocks of rows."""

        def paired(rows: list[tuple], sig: int, low: int, high: int) -> list[tuple[int, int]]:
            if low == high:
                return compare(sig, [rows], True)
            sides = [[r for r in rows if r[4] == side] for side in (low, high)]
            return compare(sig, sides, False) if all(sides) else []

        key, rows, found = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sig", "low", "high", "id", "component", "n", "sketch", "own")]
            known = batch.column("earlier")
            ends = known.offsets.to_numpy()
            values = known.values.to_numpy()
            columns.append([values[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())])
            for sig, low, high, *row in zip(*columns):
                if (sig, low, high) != key:
                    if len(rows) > 1:
                        found += paired(rows, *key)
                    key, rows = (sig, low, high), []
                    if len(found) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(found))], ["a", "b"])
                        found = []
                rows.append(tuple(row))
        if len(rows) > 1:
            found += paired(rows, *key)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(found))], ["a", "b"])

    columns = ["sig", "low", "high", "own", "id", "component", "n", "sketch", "earlier"]
    facts = prints.select("id", "n", "sketch").join(earlier, "id")
    blocks = dealt.drop("blocks", "other").join(facts, "id").select(columns).repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    return blocks.mapInArrow(walk, "a long, b long")


def link_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100
) -> DataFrame:
    """One row per document: id, ``n_shingles`` (distinct shingles of five words) and ``component_id``."""
    spark = docs.sparkSession
    threshold, scratch = Threshold(num, den), Scratch(spark, "near-copies")
    every = select_text(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    rows = every.where("id IS NOT NULL")
    all_prints = scratch.store(fingerprints(every))
    prints = all_prints.where("id IS NOT NULL AND n > 0")
    copies = prints.groupBy("n", "digest").agg(F.min("id").alias("v"))
    placed_at = scratch.store(prints.select("id", "n", "digest").join(copies, ["n", "digest"]).select(F.col("id").alias("u"), "v"))
    edges = placed_at.where("u != v")
    # Copies stand behind the smallest id of their text. An id with several texts stands for itself.
    behind = placed_at.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("other"))
    behind = scratch.store(behind.where("v = other AND u != v").select("u", "v"))

    def represented(df: DataFrame, column: str) -> DataFrame:
        found = df.join(behind.withColumnsRenamed({"u": column, "v": "front"}), column, "left")
        return found.withColumn(column, F.coalesce("front", column)).drop("front").select(df.columns)

    parts = max(8, rows.rdd.getNumPartitions())
    sets = scratch.store(shared_signatures(rows, threshold, frequent_shingles(rows), 2 * parts))
    # Sets that hash alike count as one set, which only adds pairs to look at.
    members_of = sets.select(
        F.coalesce("sig", F.xxhash64("ids")).alias("sig"), F.explode("ids").alias("id"), F.array_min("ids").alias("pivot"), "weak"
    )
    groups = scratch.store(represented(members_of.select("sig", "id", "weak"), "id").distinct())

    weak = sets.where("weak").select("sig", F.array_min("ids").alias("pivot")).distinct()
    tops = weak.groupBy("sig").agg(F.min("pivot").alias("top"))
    pairs = members_of.select(F.col("id").alias("a"), F.col("pivot").alias("b")).union(
        weak.join(tops, "sig").select(F.col("pivot").alias("a"), F.col("top").alias("b"))
    )
    pairs = represented(represented(pairs.distinct(), "a"), "b")
    tested = None
    for turn in range(3):
        asked = pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if tested is not None:
            # Each pair once before the join; Spark would join the repeated ones first.
            asked = scratch.store(asked).join(tested, ["a", "b"], "left_anti")
        answers = scratch.store(verified(possible(asked, prints, threshold), rows, threshold))
        edges = scratch.store(edges.union(answers.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))))
        tested = answers.select("a", "b") if tested is None else scratch.store(tested.union(answers.select("a", "b")))
        known = connected_components(edges, scratch)
        if turn == 2:
            break
        # What is settled stays settled, so the second turn looks at the rest of the first only.
        component = F.coalesce("component", "id").alias("component")
        asked_of = groups.select("sig", "id", "weak") if turn == 0 else members.select("sig", "id", "weak")
        placed = asked_of.join(known, "id", "left").select("sig", "id", "weak", component)
        unsettled = placed.groupBy("sig").agg(
            F.min("component").alias("least"),
            F.max("component").alias("most"),
            F.min_by("component", "id").alias("first"),
            (F.max("weak") | (F.count(F.lit(1)) > 2)).alias("many"),
        )
        unsettled = unsettled.where("least != most").drop("least", "most")
        if turn == 0:
            # A second pivot: of the members outside the first pivot's component, the one with the smallest hash.
            members = scratch.store(placed.join(unsettled, "sig"))
            rest = members.where("component != first").groupBy("sig")
            pivots = rest.agg(F.min_by("id", F.xxhash64("id")).alias("pivot"), F.min_by("component", F.xxhash64("id")).alias("of"))
            pairs = members.join(pivots, "sig").where("component != of").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        else:
            # The first pivot has met the only pair of two members; larger signatures are compared in blocks.
            open_members = placed.join(unsettled.where("many").select("sig"), "sig").select("sig", "id", "component").distinct()
            pairs = open_pairs(open_members, prints, threshold)
    found = all_prints.select("id", F.col("n").alias("n_shingles")).join(known, "id", "left")
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
