"""A positional inverted index of texts, and exact phrase and proximity searches with it.

The index is a table. A block of some megabytes of texts has a row for every term in it, or
several for a frequent one: the places of the term, ``number of the text in the block << 32 |
number of the word``, in order and as differences; cells of a frequent term carry their bounds. It also
has one row for every text. Terms of all words are kept.

A phrase is looked for from its rarest term on: frequencies come from the index, and
the places of the rarest term less its offset in the phrase are the first candidates.
They are intersected with the shifted places of the second and third rarest term in the
same block, by joins on (term, block). What is left meets the places of all other terms of its block,
``TOGETHER`` candidates at a time, so lists never meet outside their block. A phrase with a term
that the index does not have is dropped at once.

A proximity search takes the rarest distinct terms of every item and returns the places of
the rarest from which each of the others is at most ``span`` words away in the same text.

Words are runs of ASCII letters and digits and of all other characters above ASCII; A-Z
are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm.stored import Scratch
from rowmill.llm.text_arrays import blobs, numbers, slices, split_texts
from rowmill.llm.words import select_text

BLOCK_BYTES = 8_000_000
# Places in one cell of the index, and candidates of a block that are looked up together.
CELL = 4096
TOGETHER = 100_000
WINDOWS_PER_BATCH = 20_000
# Rarest terms that narrow the candidates one after the other before the rest is looked up at once.
STEPS = 3
BETWEEN = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))


def _block_rows(batch: pa.RecordBatch, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    words = split_texts(batch.column("text"), BETWEEN, lower=True)
    ids, known = numbers(words.flat)
    counts = words.per_text.astype(np.int64)
    text_of = np.repeat(np.arange(len(counts)), counts)
    places = (text_of << 32) | (np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts))
    places = places[np.argsort(ids, kind="stable")]
    hits = np.bincount(ids, minlength=len(known)) if len(known) else np.zeros(0, np.int64)
    # The places of a term in cells of bounded length, each with differences from its own first place.
    cells = -(-hits // CELL)
    terms = np.repeat(np.arange(len(known)), cells)
    nth = np.arange(len(terms)) - np.repeat(np.cumsum(cells) - cells, cells)
    lengths = np.minimum(hits[terms] - nth * CELL, CELL)
    firsts = np.cumsum(lengths) - lengths
    steps = np.diff(places, prepend=0)
    steps[firsts] = places[firsts]

    def rows(n: int, **given: pa.Array) -> pa.RecordBatch:
        given["block"] = pa.array(np.full(n, block, np.int64))
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    yield rows(
        batch.num_rows, text_no=pa.array(np.arange(batch.num_rows)), id=batch.column("id"), n_words=pa.array(counts)
    )
    for at in range(0, len(terms), 50_000):
        own, part = terms[at : at + 50_000], lengths[at : at + 50_000]
        packed = blobs(steps[firsts[at] : firsts[at] + part.sum()], part)
        first = firsts[at : at + 50_000]
        alone = cells[own] == 1
        low, high = (pa.array(places[x], mask=alone) for x in (first, first + part - 1))
        yield rows(len(part), term=known.take(pa.array(own)), hits=pa.array(part), places=packed, low=low, high=high)


class PhraseIndex:
    """The written index of a table of texts; rows of null text have no words, every row is a text of its own."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch = Scratch(docs.sparkSession, "phrase-index")
        source = select_text(docs, id_col, text_col)
        id_type = source.schema["id"].dataType
        schema = T.StructType().add("block", T.LongType()).add("term", T.StringType()).add("hits", T.LongType())
        schema = schema.add("places", T.BinaryType()).add("low", T.LongType()).add("high", T.LongType())
        schema = schema.add("text_no", T.LongType()).add("id", id_type).add("n_words", T.LongType())

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 32
            arrow = None
            for batch in slices(batches, BLOCK_BYTES):
                if arrow is None:
                    types = dict(block=pa.int64(), term=pa.string(), hits=pa.int64(), places=pa.binary())
                    types |= dict(low=pa.int64(), high=pa.int64(), text_no=pa.int64(), id=batch.schema.field("id").type, n_words=pa.int64())
                    arrow = pa.schema(list(types.items()))
                yield from _block_rows(batch, block, arrow)
                block += 1

        rows = self.scratch.store(source.mapInArrow(task, schema))
        self.postings = rows.where("term IS NOT NULL").select("block", "term", "hits", "places", "low", "high")
        self.texts = rows.where("term IS NULL").select("block", "text_no", "id", "n_words")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """``term``, ``frequency`` of those of the distinct ``terms`` that the index has."""
        known = self.postings.select("term", "hits").join(terms, "term", "left_semi")
        return known.groupBy("term").agg(F.sum("hits").alias("frequency"))


def item_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """``item``, ``terms``: every run of ``width`` words, and all words of items that have fewer but one."""
    source = select_text(items, item_col, text_col)
    schema = T.StructType().add("item", source.schema["id"].dataType).add("terms", T.ArrayType(T.StringType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_BYTES):
            words = split_texts(batch.column("text"), BETWEEN, lower=True)
            counts = words.per_text.astype(np.int64)
            begins = np.cumsum(counts) - counts
            sizes = np.minimum(counts, width)
            n = np.where(counts > 0, counts - sizes + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            first = begins[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
            for at in range(0, len(row), WINDOWS_PER_BATCH):
                own, starts = row[at : at + WINDOWS_PER_BATCH], first[at : at + WINDOWS_PER_BATCH]
                ends = np.concatenate([[0], np.cumsum(sizes[own])])
                taken = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes[own]) + np.repeat(starts, sizes[own])
                terms = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.flat.take(pa.array(taken)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), terms], names=["item", "terms"])

    return source.mapInArrow(task, schema)


def _decoded(cell: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(cell.as_buffer(), np.int64))


def _held(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are among the ``ordered`` ones."""
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _nearest(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Distance of each value to the nearest of the ``ordered`` ones."""
    at = np.searchsorted(ordered, values)
    above = ordered[np.minimum(at, len(ordered) - 1)]
    below = ordered[np.maximum(at - 1, 0)]
    return np.minimum(np.abs(above - values), np.abs(values - below))


def _narrow(candidates: DataFrame, span: int | None) -> DataFrame:
    """Candidates whose ``starts`` also fit the ``places`` of one more term.

    With a ``span`` the places have to lie within that many words of the starts,
    otherwise at the term's ``offset`` from them. ``starts`` is null at first. ``first`` and
    ``last`` are the bounds of the starts that are left.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for i in range(batch.num_rows):
                places = _decoded(batch.column("places")[i]) - (0 if span is not None else batch.column("offset")[i].as_py())
                starts = batch.column("starts")[i]
                if starts.is_valid:
                    values = np.frombuffer(starts.as_buffer(), np.int64)
                    fits = _held(values, places) if span is None else _nearest(values, places) <= span
                    places = values[fits]
                if len(places):
                    rows.append(i)
                    cells.append(places)
            left = batch.select(["phrase", "size", "block"]).take(pa.array(rows, pa.int64()))
            values = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            starts = blobs(values, np.array([len(c) for c in cells], np.int64))
            bounds = [pa.array([int(c[k]) for c in cells], pa.int64()) for k in (0, -1)]
            names = ["phrase", "size", "block", "starts", "first", "last"]
            yield pa.RecordBatch.from_arrays([*left.columns, starts, *bounds], names=names)

    wanted = candidates.select("phrase", "size", "block", "starts", "offset", "places")
    return wanted.mapInArrow(task, "phrase long, size int, block long, starts binary, first long, last long")


def _looked_up(candidates: DataFrame, postings: DataFrame, span: int | None) -> DataFrame:
    """Cells of each candidate's ``term`` in its ``block`` that may hold one of its places."""
    cells = postings.select(F.col("block").alias("in_block"), F.col("term").alias("of_term"), "places", "low", "high")
    shift, slack = (F.col("offset"), 0) if span is None else (F.lit(0), span)
    near = (F.col("low") <= F.col("last") + shift + slack) & (F.col("high") >= F.col("first") + shift - slack)
    same = (F.col("block") == F.col("in_block")) & (F.col("term") == F.col("of_term"))
    return candidates.join(cells, same & (F.col("low").isNull() | near))


def _ranked(index: PhraseIndex, phrases: DataFrame, scratch: Scratch) -> DataFrame:
    """Written rows ``phrase, size, rank, offset, term``, the rarest term of a phrase first.

    Phrases with a term that the index does not have are left out.
    """
    parts = phrases.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    known = scratch.store(index.frequencies(scratch.store(parts.select("term").distinct())))
    probes = parts.join(known, "term").groupBy("phrase", "size").agg(
        F.sort_array(F.collect_list(F.struct("frequency", "offset", "term"))).alias("probes")
    )
    full = probes.where(F.size("probes") == F.col("size"))
    rows = full.select("phrase", "size", F.posexplode("probes").alias("rank", "probe"))
    return scratch.store(rows.select("phrase", "size", "rank", "probe.offset", "probe.term"))


def _narrowed(index: PhraseIndex, probes: DataFrame, most: int, span: int | None) -> DataFrame:
    """Written candidates that fit the ``most`` rarest terms of their phrase, or all if it has fewer."""
    scratch = index.scratch
    terms = scratch.store(probes.where(F.col("rank") < most).select("term").distinct())
    postings = scratch.store(index.postings.join(terms, "term", "left_semi"))
    rarest = probes.where("rank = 0").select("phrase", "size", "offset", "term")
    found = postings.join(rarest, "term").withColumn("starts", F.lit(None).cast("binary"))
    left = scratch.store(_narrow(found, None))
    for rank in range(1, most):
        asked = probes.where(F.col("rank") == rank).select("phrase", "offset", "term")
        short = left.where(F.col("size") <= rank)
        left = scratch.store(short.unionByName(_narrow(_looked_up(left.join(asked, "phrase"), postings, span), span)))
    return left


def _places(candidates: DataFrame) -> DataFrame:
    """One row for every start."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(c.as_buffer(), np.int64) for c in batch.column("starts")]
            rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            left = batch.select(["phrase", "size", "block"]).take(pa.array(rows))
            places = pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*left.columns, places], names=["phrase", "size", "block", "place"])

    return candidates.mapInArrow(task, "phrase long, size int, block long, place long")


def _check_block(table: pa.Table) -> pa.Table:
    """Candidates of a block whose other terms all stand where the phrase has them."""
    is_posting = table.column("phrase").is_null()
    lists: dict[str, list[np.ndarray]] = {}
    postings = table.filter(is_posting)
    for term, cell in zip(postings.column("term").to_pylist(), postings.column("places")):
        lists.setdefault(term, []).append(_decoded(cell))
    places = {term: np.sort(np.concatenate(cells)) for term, cells in lists.items()}
    asked = table.filter(pc.invert(is_posting))
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, (terms, offsets) in enumerate(zip(asked.column("terms").to_pylist(), asked.column("offsets").to_pylist())):
        starts = np.frombuffer(asked.column("starts")[i].as_buffer(), np.int64)
        for term, offset in zip(terms, offsets):
            own = places.get(term)
            starts = starts[_held(starts + offset, own)] if own is not None else starts[:0]
            if not len(starts):
                break
        rows.append(np.full(len(starts), i))
        found.append(starts)
    left = asked.select(["phrase", "size", "block"]).take(pa.array(np.concatenate(rows)))
    return pa.table([*left.columns, pa.array(np.concatenate(found))], names=["phrase", "size", "block", "place"])


def _checked(index: PhraseIndex, candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """Places of the candidates that fit all terms beyond the first ranks."""
    scratch = index.scratch
    rest = probes.where(F.col("rank") >= STEPS).groupBy("phrase").agg(F.collect_list(F.struct("term", "offset")).alias("rest"))
    asked = scratch.store(
        candidates.join(rest, "phrase").select(
            "block", "phrase", "size", "starts", F.col("rest.term").alias("terms"), F.col("rest.offset").alias("offsets")
        )
    )
    # Blocks with very many candidates are looked up in several groups, each with the postings of the block.
    groups = scratch.store(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("long").alias("groups")))
    terms = scratch.store(asked.select(F.explode("terms").alias("term")).distinct())
    kinds = {"phrase": "long", "size": "int", "starts": "binary", "terms": "array<string>", "offsets": "array<int>"}
    postings = index.postings.join(terms, "term", "left_semi").join(groups, "block")
    postings = postings.select(
        "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"),
        "term",
        "places",
        *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()],
    )
    asked = asked.join(groups, "block").select(
        "block",
        F.pmod(F.xxhash64("phrase"), "groups").alias("group"),
        F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("binary").alias("places"),
        *kinds,
    )
    both = asked.unionByName(postings)
    return both.groupBy("block", "group").applyInArrow(_check_block, "phrase long, size int, block long, place long")


def _place_parts() -> list[Column]:
    return [F.shiftright("place", 32).alias("text_no"), F.col("place").bitwiseAND(F.lit(2**32 - 1)).alias("word")]


def find_phrases(index: PhraseIndex, phrases: DataFrame) -> DataFrame:
    """All occurrences of the phrases: ``phrase``, ``size``, ``block``, ``text_no``, ``word`` (number of the first word).

    ``phrases`` has distinct numbers ``phrase`` and ``terms``, lists of lower-cased words without nulls.
    """
    probes = _ranked(index, phrases, index.scratch)
    left = _narrowed(index, probes, STEPS, None)
    long = _checked(index, left.where(F.col("size") > STEPS), probes)
    found = _places(left.where(F.col("size") <= STEPS)).union(long)
    return found.select("phrase", "size", "block", *_place_parts())


def find_near(
    index: PhraseIndex, items: DataFrame, item_col: str = "item_id", text_col: str = "text", terms: int = 3, span: int = 20
) -> DataFrame:
    """Proximity matches: ``item``, ``id`` of the text, ``word`` (place of the item's rarest term).

    The ``terms`` rarest distinct words of an item must lie at most ``span`` words from its rarest
    one. Items with fewer distinct words, or with none in the index, match by those that
    the index has. Rows of null or repeated item ids are items of their own.
    """
    scratch = index.scratch
    whole = item_windows(items, item_col, text_col, 2**31 - 1)
    listed = scratch.store(whole.select(F.monotonically_increasing_id().alias("phrase"), "item", F.array_distinct("terms").alias("terms")))
    parts = listed.select("phrase", F.explode("terms").alias("term"))
    known = scratch.store(index.frequencies(scratch.store(parts.select("term").distinct())))
    best = parts.join(known, "term").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("frequency", "term"))).alias("probes"))
    best = best.select("phrase", F.slice("probes", 1, terms).alias("probes"))
    rows = best.select("phrase", F.size("probes").alias("size"), F.posexplode("probes").alias("rank", "probe"))
    probes = scratch.store(rows.select("phrase", "size", "rank", F.lit(0).alias("offset"), "probe.term"))
    left = _narrowed(index, probes, terms, span)
    # A start may be near places of two cells.
    found = _places(left).distinct().select("phrase", "block", *_place_parts())
    return found.join(listed.select("phrase", "item"), "phrase").join(index.texts, ["block", "text_no"]).select("item", "id", "word")


def covered_words(hits: Column) -> Column:
    """How many words the stretches ``word, size`` cover together."""

    def add(done: Column, hit: Column) -> Column:
        end = hit["word"] + hit["size"]
        new = F.greatest(F.lit(0), end - F.greatest(done["end"], hit["word"]))
        return F.struct((done["n"] + new).alias("n"), F.greatest(done["end"], end).alias("end"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.sort_array(hits), start, add)["n"]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside occurrences of windows of the items), ``items``.

    ``items`` are the distinct ids, as strings in order, of items that have a window in the document. Items of equal
    id count as one; windows of an item without an id mark words but list nothing. Null texts have
    no words; rows with null or repeated ids are documents of their own; other columns are ignored.
    """
    index = PhraseIndex(docs, id_col, text_col)
    scratch = index.scratch
    windows = scratch.store(item_windows(items, item_col, item_text_col, width).distinct())
    phrases = scratch.store(windows.select("terms").distinct().select(F.monotonically_increasing_id().alias("phrase"), "terms"))
    found = scratch.store(find_phrases(index, phrases))
    key = ["block", "text_no"]
    hits = found.groupBy(*key).agg(F.collect_set(F.struct("word", F.col("size").cast("long").alias("size"))).alias("hits"))
    members = windows.where("item IS NOT NULL").join(phrases, "terms").select("phrase", F.col("item").cast("string").alias("item"))
    items_of = (
        found.select(*key, "phrase").distinct().join(members, "phrase").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    marked = index.texts.join(hits, key, "left").join(items_of, key, "left")
    return marked.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(covered_words(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
