"""Periodic runs of words, found by minimizers at several scales.

A run is a stretch with smallest period ``q`` (words ``q`` apart are equal) of
``max(least, 3 * q)`` words or more that no neighbouring word extends. Periods
under ``SHORT`` are found by comparing the words with those ``q`` places on. A
longer period lies in one of the scales ``[P, 2 P)``. Let ``k = P // 2`` and
``w = k // 3``: every window of ``w`` places selects the leftmost place whose
``k`` words have the least hash. Inside a run of period ``q`` the selection
repeats ``q`` places on. Of equal selected hashes only those count that follow
the last equal one by more than ``w`` places. Were none of them left in the
inner part of a run, its ``k``-word stretches would all have one period of at
most ``k / 3`` (Fine and Wilf), and so would the run, against ``q`` being its
smallest. So two equal ones lie ``q`` apart in every run; each has at most a
dozen partners within a scale, whatever the text. Pairs seed an exact extension
over the words themselves.

Equal words are told by their numbers, not by hashes; hashes only choose seeds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm.shingles import mix
from rowmill.llm.text_arrays import SPACES, numbers, slices, split_texts
from rowmill.llm.words import select_text

LEAST = 24
TIMES = 3
SHORT = 16
SLICE_BYTES = 4_000_000
FACTOR = 0x9E3779B97F4A7C15
PLACE_BITS = np.uint64(28)
PLACES = np.uint64((1 << 28) - 1)

Order = Callable[[object, int], np.ndarray | None]
RUNS = T.ArrayType(
    T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")]), False
)


def lag_runs(ids: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all stretches with period ``q`` that are long enough."""
    same = np.flatnonzero(ids[q:] == ids[:-q])
    if not len(same):
        return same, same
    gaps = np.flatnonzero(np.diff(same) != 1)
    first, last = same[np.concatenate([[0], gaps + 1])], same[np.concatenate([gaps, [len(same) - 1]])]
    length = last - first + 1 + q
    fits = length >= max(least, TIMES * q)
    return first[fits], length[fits]


def is_smallest(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of ``q`` is a period too; a stretch of ``3 q`` words has no other smaller ones."""
    rest, prime = q, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            d = q // prime
            if np.array_equal(ids[start : start + q], ids[start + d : start + d + q]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def seeds(ids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances in ``[scale, 2 * scale)`` of equal minimizers."""
    none = np.zeros(0, np.int64)
    k = scale // 2
    w = k // 3
    n = len(ids) - k + 1
    if n < w:
        return none, none
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(ids), FACTOR, np.uint64))
        back = np.cumprod(np.full(len(ids), pow(FACTOR, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64)) * powers)])
        hashes = mix((sums[k:] - sums[:-k]) * back[:n])
    # A hash of 36 bits and, so that the leftmost of equal ones wins, the place.
    least = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    chosen = np.sort(least[np.concatenate([[True], least[1:] != least[:-1]])])
    kind, place = chosen >> PLACE_BITS, (chosen & PLACES).astype(np.int64)
    leads = np.concatenate([[True], (kind[1:] != kind[:-1]) | (place[1:] - place[:-1] > w)])
    kind, place = kind[leads], place[leads]
    at, apart = [none], [none]
    for t in range(1, len(kind)):
        distance = place[t:] - place[:-t]
        near = (kind[t:] == kind[:-t]) & (distance < 2 * scale)
        if not near.any():
            break
        near &= distance >= scale
        at.append(place[:-t][near])
        apart.append(distance[near])
    return np.concatenate(at), np.concatenate(apart)


def equal_run(ids: np.ndarray, place: int, d: int) -> tuple[int, int]:
    """The stretch of places around ``place`` whose words equal those ``d`` places on; empty if its own do not."""
    end, step, last = place, 64, len(ids) - d
    while end < last:
        stop = min(last, end + step)
        differ = ids[end:stop] != ids[end + d : stop + d]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = stop, step * 2
    start, step = place, 64
    while start > 0:
        stop = max(0, start - step)
        differ = ids[stop:start] != ids[stop + d : start + d]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = stop, step * 2
    return start, end


def find_all(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of the runs, by start and period.

    ``ids`` holds the texts one after the other, each followed by a number
    that occurs nowhere else; ``sizes`` are their lengths with it.
    """
    found: list[tuple[int, int, int]] = []
    longest = int(sizes.max(initial=1)) - 1
    for q in range(1, min(SHORT, longest // TIMES + 1)):
        for start, length in zip(*(x.tolist() for x in lag_runs(ids, q, least))):
            if is_smallest(ids, start, q):
                found.append((start, length, q))
    scale = SHORT
    while TIMES * scale <= longest:
        # Texts too short for the scale are left out; a distance over a gap is settled by the extension.
        fits = sizes > TIMES * scale
        where = np.flatnonzero(np.repeat(fits, sizes))
        at, apart = seeds(ids[where], scale)
        at = where[at]
        order = np.lexsort((at, apart))
        seen, upto = 0, -1
        for place, d in zip(at[order].tolist(), apart[order].tolist()):
            if d == seen and place < upto:
                continue
            start, end = equal_run(ids, place, d)
            seen, upto = d, end
            length = end - start + d
            if end > start and length >= max(least, TIMES * d) and is_smallest(ids, start, d):
                found.append((start, length, d))
        scale *= 2
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    order: Order | None = None,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``runs`` (by start, then period), ``collapsed`` text.

    Words are separated by the six ASCII spaces and compared as they are. ``collapsed`` joins
    by one space the words that no run contains after its first period. ``order`` may rearrange
    words before: it gets an id and the number of words and returns the numbers of the words
    to take, or None. A null text has no words; rows with null or repeated ids are treated
    each for itself; other columns are ignored. Documents are independent, so there is no shuffle.
    """
    source = select_text(docs, id_col, text_col)
    fields = [
        T.StructField(id_col, source.schema["id"].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", RUNS),
        T.StructField("collapsed", T.StringType()),
    ]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            yield runs_of_batch(batch.column("id"), batch.column("text"), least, order, id_col)

    return source.mapInArrow(task, T.StructType(fields))


def runs_of_batch(keys: pa.Array, texts: pa.Array, least: int, order: Order | None, id_col: str) -> pa.RecordBatch:
    words = split_texts(texts, SPACES)
    ids, known = numbers(words.flat)
    counts = words.per_text.astype(np.int64)
    begins = np.cumsum(counts) - counts
    if order is not None:
        parts, last = [], 0
        for row, key in enumerate(keys.to_pylist()):
            taken = order(key, int(counts[row])) if counts[row] else None
            if taken is not None:
                own = ids[begins[row] : begins[row] + counts[row]]
                parts += [ids[last : begins[row]], own[taken]]
                last = int(begins[row] + counts[row])
        ids = np.concatenate([*parts, ids[last:]])
    # Every text is followed by a number of its own.
    seams = np.cumsum(counts + 1) - 1
    joined = np.empty(len(ids) + len(counts), np.int64)
    own = np.ones(len(joined), bool)
    own[seams] = False
    joined[own] = ids
    joined[seams] = len(known) + np.arange(len(counts))
    found = find_all(joined, counts + 1, least)
    row_of = np.searchsorted(seams, found[:, 0])
    per_row = np.bincount(row_of, minlength=len(counts))
    start = found[:, 0] - (begins + np.arange(len(counts)))[row_of]
    change = np.zeros(len(joined) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = (np.cumsum(change)[:-1] == 0) & own
    kept_per_row = np.add.reduceat(kept, np.cumsum(counts + 1) - counts - 1, dtype=np.int64) if len(counts) else counts
    left = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(kept_per_row)]).astype(np.int32)), known.take(pa.array(joined[kept]))
    )
    struct = pa.StructArray.from_arrays(
        [pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])],
        fields=[pa.field(name, pa.int64(), False) for name in ("start", "length", "period")],
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
    runs = pa.ListArray.from_arrays(offsets, struct)
    runs = runs.cast(pa.list_(pa.field("element", struct.type, False)))
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(counts), runs, pc.binary_join(left, " ")], names=[id_col, "n_words", "runs", "collapsed"]
    )


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equal ones the first; null without runs."""

    def better(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
