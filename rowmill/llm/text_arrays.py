"""Words of many texts at once, as arrays.

A byte of a text belongs to a word, lies between words, or breaks a passage.
All three kinds are ASCII tests, and UTF-8 never uses those bytes inside another
character, so the texts are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """``flat``: the words of all texts; ``per_text``: how many each text has; ``fresh``: a word that follows a break."""

    flat: pa.Array
    per_text: np.ndarray
    fresh: np.ndarray


def byte_set(members: bytes) -> np.ndarray:
    """Whether each of the 256 bytes is a member."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches in runs of rows with about ``most_bytes`` of text at most, one row at least."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def split_texts(texts: pa.Array, between: bytes, breaks: bytes = b"", lower: bool = False) -> Words:
    """Words of binary ``texts`` without nulls: runs of bytes that are neither ``between`` nor ``breaks``."""
    texts = texts.cast(pa.binary()) if texts.type != pa.binary() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~byte_set(between + breaks)[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    seams = offsets[(offsets > 0) & (offsets < len(data))]
    begins[seams] = inside[seams]
    ends[seams - 1] = inside[seams - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    at = np.searchsorted(first, offsets)
    fresh = np.zeros(len(first), bool)
    fresh[at[:-1][np.diff(at) > 0]] = True
    if breaks and len(first):
        broken = np.cumsum(byte_set(breaks)[data], dtype=np.int64)[first]
        fresh[1:] |= broken[1:] != broken[:-1]
    ends_at = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
    kept = data[inside]
    packed = LOWER[kept] if lower else kept
    flat = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends_at), pa.py_buffer(packed)])
    return Words(flat, np.diff(at), fresh)


def numbers(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, equal for equal words, and the distinct words by number."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def blobs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``values`` as binary cells, ``lengths`` values each."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.dtype.itemsize
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), data])
