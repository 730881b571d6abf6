"""Word shingles of whole texts as sets of 64-bit fingerprints."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

WIDTH = 5
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordPrints(dict):
    """Fingerprints of words, remembered up to a number of words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value


def mix(values: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list[bytes], prints: WordPrints, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text with fewer words than ``width`` is one shingle."""
    split = [t.lower().split() for t in texts]
    words = np.fromiter(map(prints.__getitem__, chain.from_iterable(split)), np.uint64)
    factors = [int(f) | 1 for f in mix(np.arange(1, width + 1, dtype=np.uint64) * STEP)]

    def joined(own: np.ndarray, size: int) -> np.ndarray:
        """A value for each run of ``size`` words; every place in the run has a factor of its own."""
        n = len(own) - size + 1
        value = np.full(n, size, np.uint64)
        for k in range(size):
            value += own[k : k + n] * np.uint64(factors[k])
        return mix(value)

    everywhere = joined(words, width) if len(words) >= width else words[:0]
    out, at = [], 0
    for n in map(len, split):
        if n >= width:
            found = np.sort(everywhere[at : at + n - width + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        else:
            out.append(joined(words[at : at + n], n) if n else words[:0])
        at += n
    return out


def exact_shingles(text: bytes, width: int = WIDTH) -> set:
    """The shingles themselves, for checks."""
    words = text.lower().split()
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(width))))
