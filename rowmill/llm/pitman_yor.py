"""LM scoring: a hierarchical Pitman-Yor model of words in context.

A text is its words and one end. The context of a word is the word before it (or the start of
the text): as many context restaurants as there are words, which share the root restaurant as
parent; the root's base is even over the known words and one unknown word. A word's
customers in a context sit at tables; each table is a customer of the root.

Seating is sampled by Gibbs sweeps, a dish at a time: its customers leave and are seated
again one after another, each at an old table by its customers less the discount or at a new
one by concentration, tables and the parent's probability. Beyond 256 customers the customer who opens the
next table is drawn at once, from the same probabilities. Each sweep
takes the exact sums of the one before per word, per context and over all. What is drawn for a cell
depends on its word, its context and the sweep only, so scores don't depend on partitions or buckets. The
predictive probability of each kept sample sums to one, and the score uses the mean over samples.
``sample_seating`` and ``bucket_totals`` are the same for cells of one task and ``CONTEXTS`` numbered contexts, as an oracle in tests.

Texts are read once, into blocks of documents with the words of their tokens. Blocks ask buckets for their
distinct cells, which are dealt by the fingerprint of the pair, so a frequent word's cells are everywhere. A cell with
one customer has one table whatever is drawn; blocks count these, only cells with more are seated. Words and contexts
have homes, by the first bits of their fingerprints, which get sums from buckets and blocks and send the totals back.
All of this travels as packed arrays, a row for each pair of places, and documents are scored where
their block is. Words are told apart by 64-bit fingerprints, and so are pairs of them.

Null texts are empty: one end token. Rows without an id learn and are scored like others;
repeated rows count each. Without
training rows all probabilities are one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from copy import copy
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.shingles import STEP, WordPrints, mix
from rowmill.llm.stored import Scratch
from rowmill.llm.words import as_bytes, fresh_worker, in_slices, worker_memo

CONTEXTS = 257
START = np.uint64(256)
END = np.uint64(1)
BLOCK_TOKENS = 250_000
BUCKET_TOKENS = 4_000_000
TURNS = 4
SWEEPS, KEPT = 6, 3
THETA = 1.0
ONE_BY_ONE = 256
RARE = 4096


def pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers by byte place, all lowest bytes first: the places that are mostly zero compress to nothing."""
    values = np.ascontiguousarray(values, kind)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(packed, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack_words(words: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted fingerprints as steps between the distinct ones, and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    return pack(np.diff(words[first], prepend=np.uint64(0)), "<u8"), pack(np.diff(np.append(first, len(words))), "<u4")


def unpack_words(steps: bytes, repeats: bytes) -> np.ndarray:
    return np.repeat(np.cumsum(unpack(steps, "<u8"), dtype=np.uint64), unpack(repeats, "<u4"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, exact to the last places for arguments over a hundred."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def uniform(keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """A number in [0, 1) that depends on key and turn only."""
    return (mix(keys + (turn.astype(np.uint64) + np.uint64(1)) * STEP) >> np.uint64(11)) * 2.0**-53


def seat_keyed(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of dishes with these customers; ``weight`` is what a new table has against the seated ones.
    Draws depend on the dish's key only, not on the dishes beside it."""
    tables = (customers > 0).astype(np.int64)
    open_ = np.flatnonzero(customers > 1)
    for seated in range(1, ONE_BY_ONE):
        if not len(open_):
            return tables
        share = weight[open_] / (weight[open_] + seated - discount * tables[open_])
        tables[open_] += uniform(keys[open_], np.full(len(open_), seated)) < share
        open_ = open_[customers[open_] > seated + 1]
    # From here on the customer who opens the next table is drawn at once, by the probability that nobody did before.
    seated = np.full(len(open_), ONE_BY_ONE)
    for n, k in enumerate(open_.tolist()):
        tables[k], seated[n] = seat_queue(int(customers[k]), int(tables[k]), float(weight[k]), discount, keys[k])
    open_, seated = open_[seated < customers[open_]], seated[seated < customers[open_]]
    while len(open_):
        old, new = -discount * tables[open_], weight[open_] - discount * tables[open_]
        start = log_gamma(seated + new) - log_gamma(seated + old)
        wanted = np.log(np.maximum(uniform(keys[open_], ONE_BY_ONE + tables[open_]), 1e-300))
        low, high = seated.copy(), customers[open_] + 1
        while (high - low > 1).any():
            middle = np.where(high - low > 1, (low + high) // 2, low)
            nobody = start + log_gamma(middle + old) - log_gamma(middle + new) >= wanted
            low, high = np.where(nobody, middle, low), np.where(nobody | (middle == low), high, middle)
        opened = high <= customers[open_]
        tables[open_[opened]] += 1
        more = opened & (high < customers[open_])
        open_, seated = open_[more], high[more]
    return tables


def seat_queue(customers: int, tables: int, weight: float, discount: float, key: np.uint64) -> tuple[int, int]:
    """Tables of one dish and the customers seated so far: all, or as many as come while one in ``RARE`` opens a table.
    The next one to do so is where the probability that nobody did falls below the draw; it is multiplied up on the way."""
    seated, draws, more = ONE_BY_ONE, [], 16
    while seated < customers and seated - discount * tables <= weight * (RARE - 1):
        if not draws:
            draws = np.maximum(uniform(key, ONE_BY_ONE + tables + np.arange(more)[::-1]), 1e-300).tolist()
            more = min(2 * more, 4096)
        draw, nobody, old = draws.pop(), 1.0, seated - discount * tables
        for seated in range(seated + 1, customers + 1):  # noqa: B020
            nobody *= old / (old + weight)
            if nobody < draw:
                tables += 1
                break
            old += 1.0
    return tables, seated


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """``seat_keyed`` with keys from a generator."""
    return seat_keyed(customers, weight, discount, rng.integers(0, 2**64, len(customers), np.uint64))


def estimate_discount(ones: float, twos: float) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def sample_seating(context: np.ndarray, word: np.ndarray, customers: np.ndarray, n_words: int, share: float, seed: int):
    """Tables per cell and root tables per word of the kept samples. Cells are (context, word); ``share`` is
    the part of all words that is here."""
    rng = np.random.default_rng(seed)
    d1 = estimate_discount((customers == 1).sum(), (customers == 2).sum())
    tables = (customers > 0).astype(np.int64)
    root = (np.bincount(word, tables, n_words) > 0).astype(np.int64)
    samples = []
    for sweep in range(SWEEPS):
        served = np.bincount(word, tables, n_words).astype(np.int64)
        d0 = estimate_discount((served == 1).sum(), (served == 2).sum())
        words, all_served, all_root = (served > 0).sum() / share, served.sum() / share, root.sum() / share
        p_root = (np.maximum(served - d0 * root, 0) + (THETA + d0 * all_root) / (words + 1)) / (THETA + all_served)
        per_context = np.bincount(context, tables, CONTEXTS) / share
        tables = seat(customers, (THETA + d1 * per_context[context]) * p_root[word], d1, rng)
        served = np.bincount(word, tables, n_words).astype(np.int64)
        root = seat(served, np.full(n_words, (THETA + d0 * all_root) / (words + 1)), d0, rng)
        if sweep >= SWEEPS - KEPT:
            samples.append((tables, root, served))
    return samples


class Totals:
    """Sums over all words: customers and tables per context, root customers and tables per sample, discounts."""

    def __init__(self, values: np.ndarray):
        """``values`` as summed from the buckets, see ``bucket_totals``."""
        v = values.astype(np.int64)
        self.customers, v = v[:CONTEXTS], v[CONTEXTS:]
        self.tables, v = v[: KEPT * CONTEXTS].reshape(KEPT, CONTEXTS), v[KEPT * CONTEXTS :]
        self.root, v = v[:KEPT], v[KEPT:]
        self.known, ones, twos, root_ones, root_twos = v.tolist()
        self.d1, self.d0 = estimate_discount(ones, twos), estimate_discount(root_ones, root_twos)
        self.tokens, self.served = int(self.customers.sum()), self.tables.sum(axis=1).tolist()

    def beside(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        """The same sums beside other contexts: their customers, and tables per sample."""
        other = copy(self)
        other.customers, other.tables = customers, tables
        return other

    def log_probabilities(self, context: np.ndarray, cell: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the mean predictive probability. ``cell``: customers and tables per sample;
        ``word`` (per cell): its root customers per sample, then root tables per sample."""
        mean = np.zeros(len(context))
        for s in range(KEPT):
            served, all_served = word[:, s], self.served[s]
            root = (served - self.d0 * word[:, KEPT + s] + (THETA + self.d0 * int(self.root[s])) / (self.known + 1)) / (THETA + all_served)
            own = cell[:, 0] - self.d1 * cell[:, 1 + s]
            back = THETA + self.d1 * self.tables[s][context]
            mean += (own + back * root) / (THETA + self.customers[context])
        return np.log10(mean / KEPT)


def bucket_totals(context, customers, samples) -> np.ndarray:
    parts = [np.bincount(context, customers, CONTEXTS)]
    parts += [np.bincount(context, tables, CONTEXTS) for tables, _, _ in samples]
    parts.append([root.sum() for _, root, _ in samples])
    served = samples[-1][2] if samples else np.zeros(0, int)
    parts.append([(served > 0).sum(), (customers == 1).sum(), (customers == 2).sum(), (served == 1).sum(), (served == 2).sum()])
    return np.concatenate(parts).astype(np.int64)


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(word + mix(context))


def unmix(values: np.ndarray) -> np.ndarray:
    """The number of which ``mix`` made the value."""
    values = values ^ (values >> np.uint64(31)) ^ (values >> np.uint64(62))
    values = values * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    values = values ^ (values >> np.uint64(27)) ^ (values >> np.uint64(54))
    values = values * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return values ^ (values >> np.uint64(30)) ^ (values >> np.uint64(60))


def codec() -> pa.Codec:
    return worker_memo("codec", lambda: pa.Codec("zstd", 1))


def put(values: np.ndarray) -> bytes:
    """Numbers by byte place like ``pack``, without the places that are zero in all, compressed: many arrays meet in a
    task at once, and the JVM holds them as they are. First how many places and numbers there are."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    size = 1 << (width - 1).bit_length()
    numbers, places = np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8), np.empty((width, len(values)), np.uint8)
    for k in range(width):
        places[k] = numbers[k::size]
    return bytes([width]) + len(values).to_bytes(8, "little") + codec().compress(places.ravel(), asbytes=True)


def get(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:9], "little")
    size = 1 << (width - 1).bit_length()
    places = np.frombuffer(codec().decompress(memoryview(packed)[9:], n * width, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros(n, f"<u{size}")
    for k in range(width):
        out.view(np.uint8)[k::size] = places[k]
    return out.astype(np.uint64)


def get_counts(packed: bytes) -> np.ndarray:
    return get(packed).view(np.int64)


def put_all(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one."""
    return put(np.concatenate(arrays))


def get_all(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` arrays of ``put_all``, as rows."""
    return get_counts(packed).reshape(n, -1)


def put_sorted(values: np.ndarray) -> bytes:
    return put(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def get_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(get(packed), dtype=np.uint64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def first_bits(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; sorted keys are in order of bucket."""
    return (keys >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def last_bits(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What a key is beside its bucket."""
    return keys & np.uint64(2**64 // buckets - 1)


def whole_keys(last: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    return last + np.uint64(bucket * (2**64 // buckets))


def runs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each number of an ordered array, and from where to where it stands."""
    used, starts = np.unique(numbers, return_index=True)
    return zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(numbers)])


def joined(parts: list[np.ndarray], n: int = 1) -> np.ndarray:
    """The parts, each with ``n`` rows, side by side."""
    return np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), np.int64)


# What travels between blocks, buckets of cells and homes of words: ``source`` sends arrays to ``at``.
ROW = "kind int, at long, source long, facts array<binary>, sums array<long>"
ROW_TYPES = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("source", pa.int64()), ("facts", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


TEXTS = 9  # the kind of a block's own row


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    """``rows``: kind, at, source, facts, and sums if there are any."""
    columns = [[r[k] if k < len(r) else None for r in rows] for k in range(len(ROW_TYPES))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW_TYPES.types)], schema=ROW_TYPES)


def mapped(rows: DataFrame, work) -> DataFrame:
    """``work`` makes rows of each row; one is in Python's hands at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for k in range(batch.num_rows):
                yield as_batch(work(batch.slice(k, 1).to_pylist()[0]))

    return rows.mapInArrow(run, ROW)


def met(rows: DataFrame, work) -> DataFrame:
    """``work`` makes rows of all rows with the same ``at``."""
    return rows.groupBy("at").applyInArrow(lambda table: pa.Table.from_batches([as_batch(work(table.to_pylist()))]), ROW)


def sent(rows: DataFrame, kind: int, new_kind: int | None = None) -> DataFrame:
    return rows.where(F.col("kind") == kind).select(F.lit(kind if new_kind is None else new_kind).cast("int").alias("kind"), "at", "source", "facts")


def gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("at").agg(F.collect_list(F.struct("kind", "source", "facts")).alias("parts"))


def of_kind(rows: list[dict], kind: int) -> list[dict]:
    return sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["source"])


def block_of(ids: list, texts: list[bytes], train: list[bool]) -> list[bytes]:
    """A block's documents, its distinct words in order of fingerprint, and the word of every token."""
    prints = worker_memo("word prints", lambda: WordPrints(150_000))
    split = [t.split() for t in (t.lower() for t in texts)]
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    n = int(sizes.sum())
    at_word = np.ones(n, bool)
    at_word[np.cumsum(sizes) - 1] = False
    word = np.full(n + 1, END)
    word[:-1][at_word] = np.fromiter(map(prints.__getitem__, chain.from_iterable(split)), np.uint64, n - len(split))
    word[-1] = START
    items, place = distinct(word)
    return [json.dumps(ids).encode(), np.array(train, bool).tobytes(), put(sizes), put_sorted(items), put(place[:-1])]


def read_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of documents: ``at`` is the block, ``sums`` has its tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, train, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            facts = block_of(ids, texts, train)
            return as_batch([(TEXTS, (part << 24) + number, 0, facts, [int(get(facts[2]).sum())])])

        for batch in in_slices(batches):
            ids += batch.column("id").to_pylist()
            texts += batch.column("text").to_pylist()
            train += batch.column("train").to_pylist()
            size += batch.num_rows + batch.column("text").nbytes // 6
            if size >= BLOCK_TOKENS:
                yield emit()
                ids, texts, train, size, number = [], [], [], 0, number + 1
        if ids:
            yield emit()

    return rows.mapInArrow(read, ROW)


class Cells:
    """The distinct cells of a block in order of key: word, context (places among ``items``) and training count;
    ``cell`` has the cell of every token."""

    def __init__(self, facts: list[bytes]):
        self.ids, self.train = json.loads(facts[0]), np.frombuffer(facts[1], bool)
        self.sizes, self.items = get_counts(facts[2]), get_sorted(facts[3])
        word = get_counts(facts[4])
        context = np.empty(len(word), np.int64)
        context[1:] = word[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.items, START)
        self.keys, self.cell = distinct(mix(self.items[word] + mix(self.items)[context]))
        self.word, self.context = np.empty((2, len(self.keys)), np.int64)
        self.word[self.cell], self.context[self.cell] = word, context
        self.counts = np.bincount(self.cell, np.repeat(self.train, self.sizes), len(self.keys)).astype(np.int64)


def ask(buckets: int, row: dict) -> list[tuple]:
    """A block's cells, to their buckets."""
    own = Cells(row["facts"])
    last = last_bits(own.keys, buckets)
    return [(0, b, row["at"], [put_sorted(last[x:y]), put(own.counts[x:y])]) for b, x, y in runs(first_bits(own.keys, buckets))]


def fold(rows: list[dict]) -> list[tuple]:
    """The cells of one bucket. Kind 0: to a block the customers of its cells, and which cells' words it is to send (the
    last bit); kind 1: where a block's cells with two customers or more are among all such cells of the bucket, and which
    words it sends; kind 2: these cells. A cell with one customer has one table whatever is drawn."""
    parts = [get_sorted(r["facts"][0]) for r in rows]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    keys, counts = np.concatenate(parts), np.concatenate([get_counts(r["facts"][1]) for r in rows])
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    cell = np.cumsum(new) - 1
    customers = np.bincount(cell, counts[order]).astype(np.int64)
    many = customers > 1
    place = np.cumsum(many) - 1
    number = np.empty(len(keys), np.int64)
    number[order] = cell
    sends = np.zeros(len(keys), bool)
    sends[order[new]] = many
    out, bucket = [], rows[0]["at"]
    for r, x, y in zip(rows, [0, *ends], ends):
        own = number[x:y]
        out.append((0, r["source"], bucket, [put(2 * customers[own] + sends[x:y])]))
        shared = many[own]
        out.append((1, bucket, r["source"], [put_sorted(place[own[shared]]), np.packbits(sends[x:y][shared]).tobytes()]))
    sums = [int(customers.sum()), int((customers == 1).sum()), int((customers == 2).sum())]
    out.append((2, bucket, 0, [put_sorted(ordered[new][many]), put(customers[many])], sums))
    return out


def customers_of(parts: list[dict]) -> np.ndarray:
    return joined([get_all(p["facts"][0], 1) for p in of_kind(parts, 0)])[0]


def tell_homes(buckets: int, rows: list[dict]) -> list[tuple]:
    """Of a block and what was folded for it. Kind 0: its words, to their homes, and how many cells of one customer are
    here with that word and with that context; kind 1: to the buckets the words they lack."""
    own, said, block = Cells(of_kind(rows, TEXTS)[0]["facts"]), customers_of(rows), rows[0]["at"]
    customers, sends = said >> 1, said % 2 == 1
    alone = (customers == 1) & (own.counts == 1)
    as_word, as_context = (np.bincount(of[alone], minlength=len(own.items)) for of in (own.word, own.context))
    last, out = last_bits(own.items, buckets), []
    for h, x, y in runs(first_bits(own.items, buckets)):
        out.append((0, h, block, [put_sorted(last[x:y]), put_all(as_word[x:y], as_context[x:y])]))
    words = own.items[own.word[sends]]
    out += [(1, b, block, [put(words[x:y])]) for b, x, y in runs(first_bits(own.keys[sends], buckets))]
    return out


def pack_cells(bucket: int, words: np.ndarray, contexts: np.ndarray, customers: np.ndarray, buckets: int) -> list[tuple]:
    """Kind 0: a bucket's cells; kind 1: its words and contexts, to their homes, with the cells and customers of each in
    either part."""
    items, place = distinct(np.concatenate([words, contexts]))
    word, context = place[: len(words)], place[len(words) :]
    counts = [np.bincount(of, weights, len(items)).astype(np.int64) for weights in (None, customers) for of in (word, context)]
    last, out = last_bits(items, buckets), [(0, bucket, 0, [put_sorted(items), put(word), put(context), put(customers)])]
    for h, x, y in runs(first_bits(items, buckets)):
        out.append((1, h, bucket, [put_sorted(last[x:y]), put_all(*[c[x:y] for c in counts])]))
    return out


def name_cells(buckets: int, rows: list[dict]) -> list[tuple]:
    """``pack_cells`` of a bucket as folded (kind 2), with the words (kind 3) that blocks sent for places told (kind 1)."""
    bucket = rows[0]["at"]
    keys, customers = of_kind(rows, 2)[0]["facts"]
    keys, customers = get_sorted(keys), get_counts(customers)
    words, told = np.zeros(len(keys), np.uint64), {r["source"]: r["facts"] for r in of_kind(rows, 1)}
    for r in of_kind(rows, 3):
        places, sends = told[r["source"]]
        places = get_sorted(places)
        words[places[np.unpackbits(np.frombuffer(sends, np.uint8), count=len(places)) > 0].astype(np.int64)] = get(r["facts"][0])
    contexts = unmix(unmix(whole_keys(keys, bucket, buckets)) - words)
    return pack_cells(bucket, words, contexts, customers, buckets)


def seat_sums(served: np.ndarray, root: np.ndarray) -> list[int]:
    """Known words, root customers, root tables, words with one and with two root customers."""
    return [int(v.sum()) for v in (served > 0, served, root, served == 1, served == 2)]


def own_words(buckets: int, rows: list[dict]) -> list[tuple]:
    """A home's words: kind 0 with their sums of ``tell_homes`` (kind 0) and ``pack_cells`` (kind 1) and where each bucket's
    are, kind 1 the first answers to the buckets, kind 2 where each block's are. At first each cell has one table."""
    home, blocks, cells = rows[0]["at"], of_kind(rows, 0), of_kind(rows, 1)
    parts = [get_sorted(r["facts"][0]) for r in blocks + cells]
    items, place = distinct(np.concatenate(parts))
    places = np.split(place, np.cumsum([len(p) for p in parts])[:-1])
    alone, shared = np.zeros((2, len(items)), np.int64), np.zeros((4, len(items)), np.int64)
    for at, r in zip(places, blocks + cells):
        into = alone if r["kind"] == 0 else shared
        into[:, at] += get_all(r["facts"][1], len(into))
    served, beside = alone + shared[:2]
    seen, customers = alone + shared[2:]
    root = (served > 0).astype(np.int64)
    at_blocks, at_cells = places[: len(blocks)], places[len(blocks) :]
    sources = put_sorted(np.array([r["source"] for r in cells], np.int64))
    whole = [put_sorted(whole_keys(items, home, buckets)), *map(put, (*alone, seen, customers)), sources, *map(put_sorted, at_cells)]
    out = [(0, home, 0, whole, seat_sums(served, root))]
    out += [(1, r["source"], home, [put_all(served[at], root[at], beside[at])]) for at, r in zip(at_cells, cells)]
    return out + [(2, home, r["source"], [put_sorted(at)]) for at, r in zip(at_blocks, blocks)]


def dish_keys(turn: int, *prints: np.ndarray) -> np.ndarray:
    key = mix(np.full(1, turn, np.uint64) + STEP)
    for p in prints:
        key = mix(key + p)
    return key


def seat_cells(turn: dict, row: dict) -> list[tuple]:
    """A bucket's cells are seated. Kind 0: their tables, if kept; kind 1: tables by word and by context, to the homes."""
    items, word, context, customers = get_sorted(row["facts"][0]), *map(get_counts, row["facts"][1:])
    served, root, beside = joined([get_all(p["facts"][0], 3) for p in of_kind(row["parts"], 1)], 3)
    p_root = (np.maximum(served - turn["d0"] * root, 0.0) + turn["fresh"]) / (THETA + turn["served"])
    weight = (THETA + turn["d1"] * beside[context]) * p_root[word]
    tables = seat_keyed(customers, weight, turn["d1"], dish_keys(2 * turn["sweep"], items[word], items[context]))
    out = [(0, row["at"], turn["kept"], [put(tables)])] if turn["kept"] >= 0 else []
    by_word, by_context = (np.bincount(of, tables, len(items)).astype(np.int64) for of in (word, context))
    for h, x, y in runs(first_bits(items, turn["buckets"])):
        out.append((1, h, row["at"], [put_all(by_word[x:y], by_context[x:y])]))
    return out


def seat_words(turn: dict, row: dict) -> list[tuple]:
    """A home's words are seated at the root. Kind 0: sums, and if kept root customers, root tables, and tables by
    context; kind 1: the same, to the buckets."""
    items, alone_word, alone_context, _, _, sources = row["facts"][:6]
    served, beside = get_counts(alone_word), get_counts(alone_context)
    places = {b: get_sorted(at).astype(np.int64) for b, at in zip(get_sorted(sources).tolist(), row["facts"][6:])}
    for p in row["parts"] or []:
        at = places[p["source"]]
        by_word, by_context = get_all(p["facts"][0], 2)
        served[at] += by_word
        beside[at] += by_context
    root = seat_keyed(served, np.full(len(served), turn["fresh"]), turn["d0"], dish_keys(2 * turn["sweep"] + 1, get_sorted(items)))
    facts = (served, root, beside)
    out = [(0, row["at"], turn["kept"], [put(v) for v in facts] if turn["kept"] >= 0 else [], seat_sums(served, root))]
    if turn["sweep"] < SWEEPS - 1:
        out += [(1, b, row["at"], [put_all(*[v[at] for v in facts])]) for b, at in places.items()]
    return out


def sum_up(rows: DataFrame, kind: int, n: int) -> list[int]:
    sums = [F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(n)]
    return list(rows.where(F.col("kind") == kind).agg(*sums).first())


def sample_packed(scratch: Scratch, cells: DataFrame, homes: DataFrame, seen: list[int], buckets: int):
    """The kept samples as tables of ``seat_cells`` and of ``seat_words``, and the totals. ``cells`` are kind 0 of
    ``pack_cells``, ``homes`` are ``own_words``, ``seen``: all customers, cells with one and with two.

    A sweep is two stored tables: buckets seat their cells and send sums to the homes of words and contexts, and these
    answer with the exact sums of the sweep. No row stands for a cell and no key for a word, so no word is too frequent."""
    owned, answers = homes.where("kind = 0").select("at", "facts"), homes
    d1, now = estimate_discount(seen[1], seen[2]), sum_up(homes, 0, 5)
    sums, samples = [], []
    for sweep in range(SWEEPS):
        known, all_served, all_root, *few = now
        d0 = estimate_discount(*few)
        kept = max(-1, sweep - (SWEEPS - KEPT))
        turn = {"sweep": sweep, "kept": kept, "buckets": buckets, "d0": d0, "d1": d1, "served": all_served, "fresh": (THETA + d0 * all_root) / (known + 1)}
        asked = gathered(sent(answers, 1))
        seated = scratch.store(mapped(cells.join(asked, "at"), partial(seat_cells, turn)))
        told = gathered(sent(seated, 1))
        if 0 < sweep <= SWEEPS - KEPT:
            scratch.drop(answers)
        answers = scratch.store(mapped(owned.join(told, "at", "left"), partial(seat_words, turn)))
        now = sum_up(answers, 0, 5)
        if kept < 0:
            scratch.drop(seated)
        else:
            samples.append((seated, answers))
            sums.append(now)
    totals = Totals(np.zeros(CONTEXTS * (KEPT + 1) + KEPT + 5, np.int64))
    totals.known, totals.tokens, totals.d1 = now[0], seen[0], d1
    totals.served, totals.root = [s[1] for s in sums], [s[2] for s in sums]
    totals.d0 = estimate_discount(*now[3:])
    return [s[0] for s in samples], [s[1] for s in samples], totals


def united(*tables: DataFrame) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.union(t)
    return whole


def bucket_count(tokens: int) -> int:
    """A power of two, so that the first bits of a fingerprint are its bucket; it changes where cells meet, not what is
    drawn for them."""
    return max(16, 1 << (tokens // BUCKET_TOKENS).bit_length())


def sample_tables(scratch: Scratch, cells: DataFrame):
    """The sampler for a table with a row per cell (word, context, customers): the cells with tables per kept sample, words
    and contexts with their sums, root customers and tables per sample, and the totals."""

    def pack_rows(table: pa.Table) -> pa.Table:
        words, contexts, customers = (table.column(c).to_numpy() for c in ("word", "context", "customers"))
        return pa.Table.from_batches([as_batch(pack_cells(table.column("at")[0].as_py(), words.view(np.uint64), contexts.view(np.uint64), customers, buckets))])

    def unpack_cells(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        items, *facts = of_kind(rows, 0)[0]["facts"]
        word, context, customers = map(get_counts, facts)
        prints = get_sorted(items).view(np.int64)
        tables = [get_counts(r["facts"][0]) for r in of_kind(rows, 1)]
        return pa.table([prints[word], prints[context], customers, *tables], names=["word", "context", *CELL_FACTS])

    def unpack_homes(table: pa.Table) -> pa.Table:
        facts = word_facts(table.to_pylist())
        return pa.table([facts[0].view(np.int64), *facts[1:]], names=["word", *WORD_FACTS, *CELL_FACTS])

    ones = lambda n: F.coalesce(F.sum((F.col("customers") == n).cast("long")), F.lit(0))
    seen = list(cells.agg(F.coalesce(F.sum("customers"), F.lit(0)), ones(1), ones(2)).first())
    buckets = bucket_count(seen[0])
    dealt = cells.select(F.pmod(F.xxhash64("word", "context"), F.lit(buckets)).cast("long").alias("at"), "word", "context", "customers")
    packed = scratch.store(dealt.groupBy("at").applyInArrow(pack_rows, ROW))
    homes = scratch.store(met(sent(packed, 1), partial(own_words, buckets)))
    tables, roots, totals = sample_packed(scratch, packed.where("kind = 0").select("at", "facts"), homes, seen, buckets)
    longs = lambda *names: ", ".join(f"{n} long" for n in names)
    state = united(sent(packed, 0), *[sent(t, 0, 1) for t in tables])
    words = united(sent(homes, 0), *[sent(r, 0, 1) for r in roots])
    return (
        state.groupBy("at").applyInArrow(unpack_cells, longs("word", "context", *CELL_FACTS)),
        words.groupBy("at").applyInArrow(unpack_homes, longs("word", *WORD_FACTS, *CELL_FACTS)),
        totals,
    )


CELL_FACTS = ["customers", *[f"tables{k}" for k in range(KEPT)]]
WORD_FACTS = ["seen", *[f"served{k}" for k in range(KEPT)], *[f"root{k}" for k in range(KEPT)]]


def word_facts(rows: list[dict]) -> list[np.ndarray]:
    """Fingerprints of a home's words (kind 0), and their facts as words and as contexts with the samples (kind 1)."""
    items, _, _, seen, customers = of_kind(rows, 0)[0]["facts"][:5]
    samples = [[get_counts(f) for f in r["facts"]] for r in of_kind(rows, 1)]
    served, root, beside = zip(*samples)
    return [get_sorted(items), get_counts(seen), *served, *root, get_counts(customers), *beside]


def answer_cells(rows: list[dict]) -> list[tuple]:
    """To each block (kind 1) the tables of its cells with two customers or more in a bucket, per sample (kind 0)."""
    tables = [get_counts(r["facts"][0]) for r in of_kind(rows, 0)]
    at = lambda r: get_sorted(r["facts"][0]).astype(np.int64)
    return [(1, r["source"], r["at"], [put_all(*[t[at(r)] for t in tables])]) for r in of_kind(rows, 1) if tables]


def answer_words(rows: list[dict]) -> list[tuple]:
    """To each block (kind 2) the facts of its words that have their home here."""
    facts = np.stack(word_facts(rows)[1:])
    at = lambda r: get_sorted(r["facts"][0]).astype(np.int64)
    return [(2, r["source"], r["at"], [put(facts[:, at(r)].ravel())]) for r in of_kind(rows, 2)]


def score_block(totals: Totals, rows: list[dict]) -> pa.Table:
    """The scored documents of a block, from the answers to it."""
    own, customers = Cells(of_kind(rows, TEXTS)[0]["facts"]), customers_of(rows) >> 1
    cells = np.stack([customers] + [(customers > 0).astype(np.int64)] * KEPT)
    cells[1:, customers > 1] = joined([get_all(p["facts"][0], KEPT) for p in of_kind(rows, 1)], KEPT)
    facts = len(WORD_FACTS) + len(CELL_FACTS)
    words = joined([get_all(p["facts"][0], facts) for p in of_kind(rows, 2)], facts)
    seen, root, around = words[0], words[1 : len(WORD_FACTS)], words[len(WORD_FACTS) :]
    log = totals.beside(around[0], around[1:]).log_probabilities(own.context, cells.T, root[:, own.word].T)
    base = np.log10((seen + 0.5) / (totals.tokens + 0.5 * (totals.known + 1)))
    starts = np.cumsum(own.sizes) - own.sizes
    add = lambda values: np.add.reduceat(values[own.cell], starts)
    return pa.table(
        [
            pa.array(own.ids, pa.string()), pa.array(~own.train), pa.array(own.sizes), pa.array(add((seen > 0).astype(np.int64)[own.word])),
            pa.array(np.full(len(own.sizes), totals.tokens)), pa.array(add(base[own.word])), pa.array(add(log)),
        ],
        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (add-half unigrams) and ``score`` (log10 probability of the text under the model)."""
    scratch = Scratch(docs.sparkSession, "pitman-yor")
    rows = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = scratch.store(read_blocks(rows.withColumn("id", F.col("id").cast("string"))))
    buckets = bucket_count(sum_up(blocks, TEXTS, 1)[0])
    texts = sent(blocks, TEXTS)
    folded = scratch.store(met(mapped(texts, partial(ask, buckets)).drop("sums"), fold))
    told = scratch.store(met(united(texts, sent(folded, 0)), partial(tell_homes, buckets)))
    named = scratch.store(met(united(sent(folded, 1), sent(folded, 2), sent(told, 1, 3)), partial(name_cells, buckets)))
    homes = scratch.store(met(united(sent(told, 0), sent(named, 1)), partial(own_words, buckets)))
    scratch.drop(told)
    tables, roots, totals = sample_packed(scratch, named.where("kind = 0").select("at", "facts"), homes, sum_up(folded, 2, 3), buckets)
    of_cells = met(united(sent(folded, 1), *[sent(t, 0) for t in tables]), answer_cells)
    of_words = met(united(sent(homes, 0), sent(homes, 2), *[sent(r, 0, 1) for r in roots]), answer_words)
    answers = scratch.store(of_cells.union(of_words))
    for done in (named, homes, *tables, *roots):
        scratch.drop(done)
    # Some blocks after others, so not all of them are in shuffle files at once.
    parts, scored = united(texts, sent(folded, 0), sent(answers, 1), sent(answers, 2)), []
    for turn in range(TURNS):
        now = parts.where(F.pmod(F.col("at"), F.lit(TURNS)) == turn).groupBy("at")
        scored.append(
            scratch.store(
                now.applyInArrow(
                    lambda table: score_block(totals, table.to_pylist()),
                    "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
                )
            )
        )
    for done in (blocks, folded, answers):
        scratch.drop(done)
    found = united(*scored)
    return found.select(F.col("id").cast(kind).alias(id_col), *found.columns[1:])
