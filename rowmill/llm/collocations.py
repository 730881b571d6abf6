"""Collocations: phrases of two and three words that occur together far more often than apart.

Phrases are counted level by level, since a phrase is never more frequent than its parts.

1. Blocks of some megabytes of texts are written as word numbers of their own, with the
   block's words and counts. Words with ``least`` occurrences in their language get a global
   number, which joins back to the blocks that have the word.
2. Every block counts its pairs of frequent words in a ``HatTrie`` whose subtrees are merge
   partitions, and spills sorted runs. A partition is picked by the first word; a word with more than
   ``TARGET`` occurrences is spread over several by its second word, so no partition has to merge more
   than about that many occurrences, however hot a word is. A merge returns to every
   block which of its pairs are frequent.
3. Triples of which both pairs are frequent are counted alike, the partition of the
   first pair being theirs, and spread by the third word where the pair is hot.

The counts are exact. Only joins and groups by block or partition move data: no list of words
or phrases is broadcast or collected.

Words are runs of bytes other than space and tab, pieces end at ``.,;:!?`` and line ends, A-Z are
lower-cased, and everything is per language. A null text has no words, a null language is ``und``.
Documents are counted as they come, repeated rows and ids too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.hat_trie import HatTrie, merge
from rowmill.llm.shingles import mix
from rowmill.llm.stored import Scratch
from rowmill.llm.text_arrays import numbers, slices, split_texts
from rowmill.llm.words import as_bytes

BLOCK_BYTES = 8_000_000
TARGET = 2_000_000
BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
NUMBER_BUCKETS = 4096


def _cell(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _coded(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, which compress."""
    return _cell(np.diff(keys, prepend=np.uint64(0)))


def _decoded(cell: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(cell, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``block`` and ``lang, word, number, times`` of a word of the block, or ``data``: numbers of its words, 0 at breaks."""
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), as_bytes(F.col(text_col)).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names = ["block", "lang", "word", "number", "times", "data"]
        for batch in slices(batches, BLOCK_BYTES):
            words = split_texts(batch.column("text"), BLANKS, BREAKS, lower=True)
            if not len(words.flat):
                continue
            ids, known = numbers(words.flat)
            langs, lang_names = numbers(batch.column("lang"))
            pairs = np.repeat(langs.astype(np.int64), words.per_text) * len(known) + ids
            distinct, number, times = np.unique(pairs, return_inverse=True, return_counts=True)
            row = np.zeros(len(ids) + int(words.fresh.sum()), np.uint32)
            row[np.arange(len(ids)) + np.cumsum(words.fresh)] = number + 1
            for at in range(0, len(distinct), 50_000):
                part = distinct[at : at + 50_000]
                columns = [
                    pa.array(np.full(len(part), block)),
                    lang_names.take(pa.array(part // len(known))),
                    known.take(pa.array(part % len(known))),
                    pa.array(np.arange(at + 1, at + len(part) + 1)),
                    pa.array(times[at : at + 50_000]),
                    pa.nulls(len(part), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            last = [[block], [None], [None], [None], [None], [_cell(row)]]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(last, kinds)], names=names)
            block += 1

    return source.mapInArrow(task, "block long, lang string, word string, number long, times long, data binary")


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``keys`` with a dense ``id`` from 1; no task orders more than a bucket of them."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(NUMBER_BUCKETS)))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket, NUMBER_BUCKETS at most.
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    joined = bucketed.withColumn("inside", inside).join(F.broadcast(offsets), "bucket")
    return joined.withColumn("id", F.col("inside") + F.col("before")).drop("bucket", "inside", "before")


def _spread(f: Column, target: int) -> Column:
    """Over how many partitions something with ``f`` occurrences is spread."""
    return F.ceil(f / F.lit(target)).cast("long")


class _Runs:
    """Rows of runs, as a trie spills them."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, bytes, bytes]] = []

    def __call__(self, partition: int, keys: np.ndarray, counts: np.ndarray) -> None:
        self.rows.append((partition, _coded(keys), _cell(counts.astype(np.uint32))))


def _counted_pairs(partitions: int, id_bits: int):
    """For the words and the text of one block: its text in global numbers, and runs of its pairs."""

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        data = [c for c in table.column("data").to_pylist() if c is not None]
        row = np.frombuffer(data[0], np.uint32) if data else np.zeros(0, np.uint32)
        known = table.filter(pc.is_valid(table.column("id")))
        local = known.column("number").to_numpy()
        ids = np.zeros(int(row.max(initial=0)) + 1, np.uint64)
        spans = np.ones(len(ids), np.uint64)
        ids[local], spans[local] = known.column("id").to_numpy(), known.column("span").to_numpy()
        text = ids[row]
        first, second = text[:-1], text[1:]
        at = np.flatnonzero((first > 0) & (second > 0))
        first, second, span = first[at], second[at], spans[row[:-1][at]]
        runs = _Runs()
        trie = HatTrie(runs, 32 + id_bits)
        with np.errstate(over="ignore"):
            where = (mix(first) % np.uint64(partitions) + mix(second) % span) % np.uint64(partitions)
        trie.add(where.astype(np.int64), first << np.uint64(32) | second)
        trie.flush()
        rows = [(None, None, None, _cell(text.astype(np.uint32))), *[(*r, None) for r in runs.rows]]
        part, keys, counts, texts = zip(*rows)
        return pa.table(
            {
                "block": pa.array([block] * len(rows), pa.int64()),
                "part": pa.array(part, pa.int64()),
                "keys": pa.array(keys, pa.binary()),
                "counts": pa.array(counts, pa.binary()),
                "data": pa.array(texts, pa.binary()),
            }
        )

    return count


def _merged_pairs(least: int, target: int):
    """For the runs of one partition: its frequent pairs, and for every block those that it has."""

    def together(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        runs = [_decoded(c) for c in table.column("keys").to_pylist()]
        counts = [np.frombuffer(c, np.uint32).astype(np.int64) for c in table.column("counts").to_pylist()]
        keys, times = merge(list(zip(runs, counts)))
        keep = times >= least
        keys, times = keys[keep], times[keep]
        spans = -(-times // target)
        blocks, own, index, span = [], [], [], []
        for block, run in zip(table.column("block").to_pylist(), runs):
            at = np.minimum(np.searchsorted(keys, run), max(len(keys) - 1, 0))
            at = at[keys[at] == run] if len(keys) else at[:0]
            if len(at):
                blocks.append(block)
                own.append(_coded(keys[at]))
                index.append(_cell(at.astype(np.uint32)))
                span.append(_cell(spans[at].astype(np.uint32)))
        n, m = len(keys), len(blocks)
        return pa.table(
            {
                "part": pa.array([part] * (n + m), pa.int64()),
                "pair": pa.concat_arrays([pa.array(np.arange(n)), pa.nulls(m, pa.int64())]),
                "first": pa.concat_arrays([pa.array((keys >> np.uint64(32)).astype(np.int64)), pa.nulls(m, pa.int64())]),
                "second": pa.concat_arrays([pa.array((keys & np.uint64(2**32 - 1)).astype(np.int64)), pa.nulls(m, pa.int64())]),
                "f": pa.concat_arrays([pa.array(times), pa.nulls(m, pa.int64())]),
                "block": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(blocks, pa.int64())]),
                "keys": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(own, pa.binary())]),
                "pairs": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(index, pa.binary())]),
                "spans": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(span, pa.binary())]),
            }
        )

    return together


def _counted_triples(table: pa.Table) -> pa.Table:
    """For the text of one block and its frequent pairs: runs of its triples of which both pairs are frequent."""
    data = [c for c in table.column("data").to_pylist() if c is not None]
    text = np.frombuffer(data[0], np.uint32).astype(np.uint64) if data else np.zeros(0, np.uint64)
    known = table.filter(pc.is_valid(table.column("keys")))
    runs = _Runs()
    if known.num_rows and len(text) > 2:
        lists = [_decoded(c) for c in known.column("keys").to_pylist()]
        keys = np.concatenate(lists)
        pairs, spans = (
            np.concatenate([np.frombuffer(c, np.uint32) for c in known.column(name).to_pylist()]).astype(np.uint64)
            for name in ("pairs", "spans")
        )
        parts = np.repeat(known.column("part").to_numpy(), [len(x) for x in lists])
        order = np.argsort(keys, kind="stable")
        keys, pairs, spans, parts = keys[order], pairs[order], spans[order], parts[order]
        asked = text[:-1] << np.uint64(32) | text[1:]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        frequent = keys[at] == asked
        where = np.flatnonzero(frequent[:-1] & frequent[1:])
        at, third = at[where], text[where + 2]
        trie = HatTrie(runs, 48)
        trie.add((parts[at] << 20) + (mix(third) % spans[at]).astype(np.int64), pairs[at] << np.uint64(32) | third)
        trie.flush()
    part, own, counts = zip(*runs.rows) if runs.rows else ((), (), ())
    return pa.table(
        {
            "part": pa.array([p >> 20 for p in part], pa.int64()),
            "salt": pa.array([p & (2**20 - 1) for p in part], pa.int64()),
            "keys": pa.array(own, pa.binary()),
            "counts": pa.array(counts, pa.binary()),
        }
    )


def _merged_triples(least: int):
    def together(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        runs = [_decoded(c) for c in table.column("keys").to_pylist()]
        counts = [np.frombuffer(c, np.uint32).astype(np.int64) for c in table.column("counts").to_pylist()]
        keys, times = merge(list(zip(runs, counts)))
        keep = times >= least
        keys, times = keys[keep], times[keep]
        return pa.table(
            {
                "part": pa.array(np.full(len(keys), part, np.int64)),
                "pair": pa.array((keys >> np.uint64(32)).astype(np.int64)),
                "third": pa.array((keys & np.uint64(2**32 - 1)).astype(np.int64)),
                "f": pa.array(times),
            }
        )

    return together


class PhraseCounts:
    """Exact counts of the frequent phrases of one, two and three words.

    ``sizes``: ``lang, n``. ``words``: ``id, lang, word, f``. ``pairs``: ``first, second, f``, and
    ``triples``: ``first, second, third, f, f_first`` (of its first pair), of word ids.
    """

    def __init__(self, docs: DataFrame, text_col: str, lang_col: str, least: int, target: int):
        if least < 1:
            raise ValueError("least must be at least 1")
        self.scratch = scratch = Scratch(docs.sparkSession, "collocations")
        given = scratch.store(blocks(docs, text_col, lang_col))
        words = given.where("word IS NOT NULL")
        self.sizes = scratch.store(words.groupBy("lang").agg(F.sum("times").alias("n")))
        counted = words.groupBy("lang", "word").agg(F.sum("times").alias("f")).where(F.col("f") >= least)
        self.words = scratch.store(numbered(counted, "lang", "word"))
        total = self.sizes.agg(F.sum("n")).first()[0] or 0
        kinds = self.words.agg(F.max("id")).first()[0] or 0
        if kinds >= 2**32:
            raise ValueError("more than 2^32 frequent words")
        partitions = -(-total // target) or 1

        span = _spread(F.col("f"), target).alias("span")
        known = words.select("block", "lang", "word", "number").join(self.words.select("lang", "word", "id", span), ["lang", "word"])
        none = [F.lit(None).cast("long").alias(c) for c in ("number", "id", "span")]
        texts = given.where("data IS NOT NULL").select("block", *none, "data")
        by_block = known.select("block", "number", "id", "span", F.lit(None).cast("binary").alias("data")).unionByName(texts)
        level = scratch.store(
            by_block.groupBy("block").applyInArrow(
                _counted_pairs(partitions, int(kinds).bit_length()), "block long, part long, keys binary, counts binary, data binary"
            )
        )
        scratch.drop(given)
        merged = scratch.store(
            level.where("part IS NOT NULL").select("block", "part", "keys", "counts").groupBy("part").applyInArrow(
                _merged_pairs(least, target),
                "part long, pair long, first long, second long, f long, block long, keys binary, pairs binary, spans binary",
            )
        )
        replies = merged.where("keys IS NOT NULL").select("block", "part", "keys", "pairs", "spans", F.lit(None).cast("binary").alias("data"))
        none = [F.lit(None).cast("binary").alias(c) for c in ("keys", "pairs", "spans")]
        texts = level.where("data IS NOT NULL").select("block", F.lit(None).cast("long").alias("part"), *none, "data")
        runs = replies.unionByName(texts).groupBy("block").applyInArrow(_counted_triples, "part long, salt long, keys binary, counts binary")
        triples = runs.groupBy("part", "salt").applyInArrow(_merged_triples(least), "part long, pair long, third long, f long")
        pairs = merged.where("pair IS NOT NULL").select("part", "pair", "first", "second", "f")
        self.pairs = pairs.select("first", "second", "f")
        self.triples = scratch.store(
            triples.join(pairs.withColumnRenamed("f", "f_first"), ["part", "pair"]).select("first", "second", "third", "f", "f_first")
        )
        scratch.drop(level)


def _score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 * a * a / (left * right))`` without rounding; 1,000,000 at most, as no part is rarer than ``a``."""
    return F.expr(
        f"(CAST(1000000 AS DECIMAL(7,0)) * (CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))))"
        f" DIV (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))"
    )


def scored(counts: PhraseCounts, inside: int = 50) -> DataFrame:
    """The candidates ``first, second, third`` (word ids, third null in pairs), ``a, l, r, score``, contained ones dropped."""
    f_of = counts.words.select("id", "f")

    def with_f(rows: DataFrame, word: str, name: str) -> DataFrame:
        return rows.join(f_of.select(F.col("id").alias(word), F.col("f").alias(name)), word)

    pairs = with_f(with_f(counts.pairs.withColumnRenamed("f", "a"), "first", "l"), "second", "r")
    longer = counts.triples.select("first", "second", "f").union(counts.triples.select("second", "third", "f"))
    longest = longer.groupBy("first", "second").agg(F.max("f").alias("within"))
    pairs = pairs.join(longest, ["first", "second"], "left").where("within IS NULL OR 100 * within < %d * a" % inside)
    pairs = pairs.select("first", "second", F.lit(None).cast("long").alias("third"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    ends = counts.pairs.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("f").alias("f_last"))
    triples = with_f(with_f(counts.triples.withColumnRenamed("f", "a"), "first", "w_first"), "third", "w_last").join(ends, ["second", "third"])
    triples = triples.withColumns({"cut1": _score("a", "w_first", "f_last"), "cut2": _score("a", "f_first", "w_last")})
    early = F.col("cut1") <= F.col("cut2")
    triples = triples.select(
        "first",
        "second",
        "third",
        "a",
        F.when(early, F.col("w_first")).otherwise(F.col("f_first")).alias("l"),
        F.when(early, F.col("f_last")).otherwise(F.col("w_last")).alias("r"),
        F.least("cut1", "cut2").alias("score"),
    )
    return pairs.unionByName(triples)


def _at_least(rows: DataFrame, key: str, value: str, top: int, scratch: Scratch) -> DataFrame:
    """Per key the ``least`` ``value`` that the first ``top`` rows by it reach.

    Rows are counted per value first, so a task orders distinct values only.
    """
    kinds = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    above = kinds.withColumn("above", F.coalesce(F.sum("rows").over(upto), F.lit(0))).where(F.col("above") < top)
    return scratch.store(above.groupBy(key).agg(F.min(value).alias("least")))


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside: int = 50, top: int = 2000, target: int = TARGET
) -> DataFrame:
    """The first ``top`` collocations of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases of two or three words with ``a >= least`` occurrences. A phrase is cut where
    ``floor(1000000 * a * a / (l * r))`` is least (``l``, ``r``: occurrences of its parts), of equal cuts the
    first. Phrases inside a longer candidate with ``100 * f(longer) >= inside * a`` are left out. Order: ``score``
    and ``a`` downwards, then the phrase by its bytes. ``n``: words of the language.
    """
    counts = PhraseCounts(docs, text_col, lang_col, least, target)
    scratch = counts.scratch
    langs = counts.words.select(F.col("id").alias("first"), "lang")
    rows = scratch.store(scored(counts, inside).join(langs, "first"))
    # Only what can be among the first: by score, then by count among those with the last score.
    bound = _at_least(rows, "lang", "score", top, scratch).withColumnRenamed("least", "least_score")
    near = scratch.store(rows.join(bound, "lang").where("score >= least_score"))
    # Of those with the last score only the first ``top`` by count can still be reached.
    edge = _at_least(near.where("score = least_score"), "lang", "a", top, scratch).select("lang", F.col("least").alias("least_a"))
    left = near.join(edge, "lang").where("score > least_score OR a >= least_a")
    for name in ("first", "second", "third"):
        spelled = counts.words.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"))
        left = left.join(spelled, name, "left")
    phrase = F.concat_ws(" ", "first_word", "second_word", "third_word")
    found = left.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # Equal scores and counts may be many, so they are cut in salted parts first.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    some = some.where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(counts.sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
