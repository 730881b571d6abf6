"""Counting of 64-bit keys in burstable hash containers under a shallow trie.

A key packs two numbers, the number of a word (or of a phrase of two) above the
number of the next word. The root has a subtree for every merge partition. A
subtree starts as one hash container. A container with more than ``burst`` keys bursts:
a node takes its place whose children, containers again, hold the keys with the
same next eight bits. The children in order hold the keys in order, so a subtree can
be written as one sorted run. With more than ``most`` keys in all, the largest
subtrees are spilled as runs until half of that is left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np

Spill = Callable[[int, np.ndarray, np.ndarray], None]


class HatTrie:
    """``spill(partition, sorted keys, counts)`` gets every run."""

    def __init__(self, spill: Spill, key_bits: int, burst: int = 32_768, most: int = 1_000_000):
        self.spill, self.burst, self.most = spill, burst, most
        self.shifts = [max(0, key_bits - 8 * depth) for depth in range(1, 9)]
        self.roots: dict[int, Counter | dict] = {}
        self.sizes: dict[int, int] = {}
        self.size = 0

    def add(self, partitions: np.ndarray, keys: np.ndarray) -> None:
        """Count every key once for each time it stands there."""
        for partition, own in _grouped(partitions, keys):
            root = self.roots.get(partition)
            if root is None:
                root = Counter()
            before = self.sizes.get(partition, 0)
            self.roots[partition], more = self._insert(root, own, 0)
            self.sizes[partition] = before + more
            self.size += more
            if self.size > self.most:
                self._relieve()

    def _insert(self, node: Counter | dict, keys: np.ndarray, depth: int) -> tuple[Counter | dict, int]:
        """The node with the keys, and how many new ones it has."""
        if isinstance(node, Counter):
            before = len(node)
            node.update(keys.tolist())
            more = len(node) - before
            return (self._split(node, depth) if len(node) > self.burst and self.shifts[depth] else node), more
        more = 0
        for digit, own in _grouped(self._digits(keys, depth), keys):
            child = node.get(digit)
            node[digit], new = self._insert(Counter() if child is None else child, own, depth + 1)
            more += new
        return node, more

    def _digits(self, keys: np.ndarray, depth: int) -> np.ndarray:
        # The first level takes whatever lies above, so keys of more bits keep their order.
        digits = (keys >> np.uint64(self.shifts[depth])).astype(np.int64)
        return digits & 255 if depth else digits

    def _split(self, node: Counter, depth: int) -> dict:
        keys, counts = _sorted(node)
        children = {}
        digits = self._digits(keys, depth)
        firsts = np.flatnonzero(np.diff(digits, prepend=digits[0] - 1))
        for first, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(keys)]):
            children[int(digits[first])] = Counter(dict(zip(keys[first:end].tolist(), counts[first:end].tolist())))
        return children

    def _relieve(self) -> None:
        for partition in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.size <= self.most // 2:
                break
            self._write(partition)

    def _write(self, partition: int) -> None:
        keys, counts = _sorted(self.roots.pop(partition))
        self.size -= self.sizes.pop(partition)
        self.spill(partition, keys, counts)

    def flush(self) -> None:
        """Spill all that is left."""
        for partition in sorted(self.roots):
            self._write(partition)


def _sorted(node: Counter | dict) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(node, Counter):
        keys = np.fromiter(node.keys(), np.uint64, len(node))
        order = np.argsort(keys)
        return keys[order], np.fromiter(node.values(), np.int64, len(node))[order]
    parts = [_sorted(node[digit]) for digit in sorted(node)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _grouped(groups: np.ndarray, keys: np.ndarray):
    """``(group, its keys)`` for every group."""
    if not len(keys):
        return
    lowest = groups.min()
    small = groups - lowest
    if small.max() < 2**16:
        small = small.astype(np.uint16)
    order = np.argsort(small, kind="stable")
    ordered = groups[order]
    firsts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    for first, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(keys)]):
        yield int(ordered[first]), keys[order[first:end]]


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run with the summed counts of several."""
    keys = np.concatenate([r[0] for r in runs])
    counts = np.concatenate([r[1] for r in runs])
    # A stable sort joins the runs as they stand.
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[firsts], np.add.reduceat(counts, firsts)
