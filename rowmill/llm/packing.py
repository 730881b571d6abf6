"""Packing: deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of tokens in table order. A window of ``window`` tokens
takes from every queue what its share has fallen due: the quantum of the window
plus the deficit carried over from the windows before. As documents may be cut
anywhere, a queue's deficit after a window is always the fraction of a token that
could not be dealt, so the tokens a queue has dealt after ``p`` tokens in all are
``floor(hi * p / total) - floor(lo * p / total)``, where ``lo`` and ``hi`` are the
running sums of the queue totals before and after it. These counts telescope to ``p`` over
the queues, so windows are full to the token, and each task knows the deficits at
every window without running the windows before it: they carry across windows
and partitions alike.

Targets default to the sources' own shares of tokens, which hold to the last
window. With other weights the shares hold until a queue runs dry; the others
then share by their weights. A source whose share is less than one token in 1024 has a
queue of its own too, but is dealt ``GRAIN`` tokens at a time: its grains lie evenly over the time in
which its share lets it run dry, and the grains of all such sources, sorted by time, are one
lane that the windows deal like a queue, with the sum of their shares. What a dry one leaves goes
to the others of the lane first.

The last window, if not full, is cut into sequences of powers of two.

Null texts are empty and have only the end id; a null source is the empty
source; repeated rows are packed each. An empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.token_ids import WordIds
from rowmill.llm.words import fresh_worker, in_slices, select_text, worker_memo
from rowmill.session import scratch_dir

POOL_SHARE = 1024
GRAIN = 64
# The weight of a source that the caller's weights don't name, and the least weight.
UNASKED, LEAST = 1.0 / POOL_SHARE, 1e-6


class Schedule:
    """Which part of which window every token of a queue goes to."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = 2048):
        """``totals`` are the tokens of the queues, in order; ``weights`` default to them."""
        self.window, self.total = window, sum(totals)
        # Per phase: first position, length, and per queue (running total before, own tokens, own tokens of earlier phases).
        self.phases: list[tuple[int, int, dict[int, tuple[int, int, int]]]] = []
        done, at = [0] * len(totals), 0
        while at < self.total:
            left = [t - d for t, d in zip(totals, done)]
            live = [q for q, n in enumerate(left) if n]
            if weights is None:
                take = dict(zip(live, (left[q] for q in live)))
            else:
                wanted = {q: max(1, round(weights[q] * 1_000_000)) for q in live}
                first = min(live, key=lambda q: left[q] / wanted[q])
                take = {q: min(left[q], left[first] * wanted[q] // wanted[first]) for q in live}
                take = {q: n for q, n in take.items() if n}
            # A phase of a few windows could deal a rare queue back; its queues then go one by one.
            short = sum(take.values()) <= 4 * window
            for group in [{q: n} for q, n in take.items()] if short and len(take) > 1 else [take]:
                lows, length = {}, 0
                for q, n in group.items():
                    lows[q] = (length, n, done[q])
                    length += n
                    done[q] += n
                self.phases.append((at, length, lows))
                at += length

    def tail(self) -> list[int]:
        """Sizes of the sequences that the last window is cut into, if it isn't full."""
        rest = self.total % self.window
        return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]

    def pieces(self, queue: int, first: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document with ``length`` tokens from ``first`` on in its queue."""
        last_full, cuts = self.total // self.window, self.tail()
        for start, n, sequence, offset in self._cells(queue, first, length):
            if sequence < last_full:
                yield start, n, sequence, offset
                continue
            low = 0
            for k, size in enumerate(cuts):
                a, b = max(offset, low), min(offset + n, low + size)
                if a < b:
                    yield start + a - offset, b - a, last_full + k, a - low
                low += size

    def _cells(self, queue: int, first: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        w, end = self.window, first + length
        for origin, size, lows in self.phases:
            low, own, earlier = lows.get(queue, (0, 0, 0))
            a, b = max(first, earlier), min(end, earlier + own)
            if a >= b:
                continue
            a, b = a - earlier, b - earlier
            high = low + own

            def dealt(p: int) -> int:
                return high * p // size - low * p // size

            def edge(k: int) -> int:
                return min(max(k * w - origin, 0), size)

            k = (a * size // own + origin) // w
            while dealt(edge(k)) > a:
                k -= 1
            while dealt(edge(k + 1)) <= a:
                k += 1
            while a < b:
                p, q = edge(k), edge(k + 1)
                n = min(b, dealt(q)) - a
                if n > 0:
                    others = low * q // size - low * p // size
                    yield a + earlier - first, n, k, max(origin - k * w, 0) + others + a - dealt(p)
                    a += n
                k += 1


def grain_offsets(small: DataFrame) -> DataFrame:
    """``queue``, ``grain`` and its ``offset`` in the lane; ``small`` has ``queue``, tokens ``n`` and ``rate`` per source."""
    spark = small.sparkSession
    many = F.ceil(F.col("n") / GRAIN)
    phase = F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / (1 << 20)
    grains = small.withColumn("grain", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).select(
        "queue",
        "grain",
        F.least(F.lit(GRAIN).cast("long"), F.col("n") - F.col("grain") * GRAIN).alias("size"),
        ((F.col("grain") + phase) / many * (F.col("n") / F.col("rate"))).alias("time"),
    )
    order = ["time", "queue", "grain"]
    path = scratch_dir(spark, "packing-grains")
    grains.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.schema("queue string, grain long, size long, time double, part int").parquet(path)
    # One sum per partition of the sort.
    bases, at = [], 0
    for r in stored.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():
        bases.append((r.part, at))
        at += r.size
    ahead = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = stored.withColumn("within", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    return within.join(spark.createDataFrame(bases, "part int, base long"), "part").select(
        "queue", "grain", (F.col("base") + F.col("within")).alias("offset")
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    queue_col: str = "source",
    window: int = 2048,
    end_id: int = 1,
    weights: dict[str, float] | None = None,
    word_bytes: int = 200_000_000,
) -> DataFrame:
    """Pieces of all documents: id, ``start``, ``length``, ``ids`` (unsigned 32-bit little-endian),
    ``doc_tokens``, ``sequence_id``, ``offset`` and ``queue``.

    Texts are tokenised once, into a table in the shared scratch folder that also
    holds each document's place among its task's tokens of the source. It is joined to
    the places of sources and tasks, and for small sources to their grains.
    ``word_bytes`` bounds what a worker remembers of words it has met.
    """
    spark = docs.sparkSession
    rows = select_text(docs, id_col, text_col, queue_col).select(
        "id", "text", F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"word ids {vocabulary} {word_bytes}"
        fresh_worker(keep=name)
        encoder = worker_memo(name, lambda: WordIds(vocabulary, word_bytes))
        narrow = encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        part, dealt = TaskContext.get().partitionId(), {}
        for batch in in_slices(batches):
            ids, ends = encoder.encode(batch.column("text"), end_id)
            stored = ids.astype("<u2" if narrow else "<u4")
            starts = np.concatenate([[0], ends[:-1]])
            before = []
            for queue, n in zip(batch.column("queue").to_pylist(), (ends - starts).tolist()):
                before.append(dealt.get(queue, 0))
                dealt[queue] = before[-1] + n
            cells = [stored[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("queue"),
                    pa.array([part] * len(cells), pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array(before, pa.int64()),
                    pa.array([stored.itemsize] * len(cells), pa.int32()),
                    pa.array(cells, pa.binary()),
                ],
                ["id", "queue", "slice", "n", "before", "width", "ids"],
            )

    path = scratch_dir(spark, "packing")
    schema = f"id {kind}, queue string, slice long, n long, before long, width int, ids binary"
    rows.mapInArrow(tokenise, schema).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(schema).parquet(path)

    counts = tokens.groupBy("queue", "slice").agg(F.sum("n").alias("n"))
    sources = counts.groupBy("queue").agg(F.sum("n").alias("n"))
    if weights is None:
        sources = sources.withColumn("rate", F.col("n").cast("double"))
    else:
        asked = spark.createDataFrame([(q, max(float(w), LEAST)) for q, w in weights.items()], "queue string, rate double")
        sources = sources.join(asked, "queue", "left").withColumn("rate", F.coalesce("rate", F.lit(UNASKED)))
    total, rates = (v or 0 for v in sources.agg(F.sum("n"), F.sum("rate")).first())
    # At most POOL_SHARE sources can have that share.
    large = sources.where(F.col("rate") * POOL_SHARE >= F.lit(float(rates))).orderBy("queue").collect()
    shared, rest = len(large), total - sum(r.n for r in large)
    sizes, shares = [r.n for r in large], [r.rate for r in large]
    if rest:
        sizes, shares = [*sizes, rest], [*shares, max(rates - sum(shares), LEAST)]
    schedule = Schedule(sizes, shares if weights is not None else None, window)

    lanes = spark.createDataFrame([(r.queue, i) for i, r in enumerate(large)], "queue string, lane int")
    ahead = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .join(lanes, "queue", "left")
        .select("queue", "slice", F.coalesce("lane", F.lit(shared)).alias("lane"), "base")
    )
    first = (F.col("base") + F.col("before")).alias("first")
    placed = tokens.join(places, ["queue", "slice"]).select(
        "id", "queue", "lane", first, "n", "width", "ids", F.lit(0).cast("long").alias("begin"), F.col("n").alias("doc_tokens")
    )
    if rest:
        offsets = grain_offsets(sources.join(lanes, "queue", "left_anti"))
        end = F.col("first") + F.col("n")
        split = placed.where(F.col("lane") == shared).withColumn(
            "grain", F.explode(F.sequence(F.floor(F.col("first") / GRAIN), F.floor((end - 1) / GRAIN)))
        )
        low = F.greatest("first", F.col("grain") * GRAIN)
        size = F.least(end, (F.col("grain") + 1) * GRAIN) - low
        begin = low - F.col("first")
        ids = F.substr("ids", (begin * F.col("width") + 1).cast("int"), (size * F.col("width")).cast("int"))
        small = (
            split.select("id", "queue", "lane", "grain", (low - F.col("grain") * GRAIN).alias("inside"), size.alias("n"), "width", ids.alias("ids"), begin.alias("begin"), "doc_tokens")
            .join(offsets, ["queue", "grain"])
            .withColumn("first", F.col("offset") + F.col("inside"))
        )
        placed = placed.where(F.col("lane") < shared).unionByName(small.select(*placed.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        fresh_worker()
        for batch in in_slices(batches, "ids"):
            source, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("lane", "first", "n", "width", "ids", "begin", "doc_tokens"))
            for i, (queue, first, n, width, ids, begin, doc_tokens) in enumerate(zip(*columns)):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for start, length, sequence, offset in schedule.pieces(queue, first, n):
                    source.append(i)
                    out.append((begin + start, length, wide[start : start + length].tobytes(), doc_tokens, sequence, offset))
            at = pa.array(source, pa.int64())
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("queue").take(at), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["id", "queue", *names],
            )

    pieces = placed.mapInArrow(
        cut, f"id {kind}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumnRenamed("id", id_col)
