"""SentencePiece encoding and decoding: N-best segmentation of whole texts.

Every run of characters that the vocabulary holds is an edge of the piece lattice;
its cost is the piece's negative log-probability in whole millionths. A forward Viterbi
pass gives the least cost to each position, which is the exact heuristic for an A-star
search backward from the end: its first N finished paths are the N best segmentations.

No piece of the vocabulary goes from another character on to a blank, so the lattice
falls apart before every blank. Each worker remembers the best path of the words it has met and how
much the second best costs more. Of a text's words only the N-1 with the
least extra cost can differ from their best path among the N best texts; for these the
search lists N paths each, and the N least sums are taken.

Vocabularies whose scores are merge ranks (whole numbers) get Zipf's probabilities for
their ranks. As in the library, a blank goes before the text and blanks become U+2581.
Characters without a piece, and U+2581 itself, become byte pieces, so decoding gives back every text.

Null texts are empty and have no pieces and one segmentation. Repeated rows are encoded
each. Ties go to the segmentation whose last pieces are longer, then to the earlier word.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.words import as_bytes, fresh_worker, in_slices, worker_memo

WORD = re.compile(r" *[^ \n]+| +|\n")
UNIT = 1_000_000
SLICE_BYTES = 1_000_000
SLICE_IDS = 200_000


class Lattice:
    """Pieces, costs and paths of one vocabulary; remembers up to about ``most`` words."""

    def __init__(self, model: str, most: int = 300_000):
        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        size = vocabulary.get_piece_size()
        scores = [vocabulary.get_score(i) for i in range(size)]
        plain = [i for i in range(size) if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_unused(i) or vocabulary.is_byte(i))]
        if all(scores[i] == int(scores[i]) for i in plain):
            ranks = sorted(plain, key=lambda i: (-scores[i], i))
            norm = math.log(sum(1 / (r + 2) for r in range(len(ranks))))
            logs = {i: -math.log(r + 2) - norm for r, i in enumerate(ranks)}
        else:
            logs = {i: scores[i] for i in plain}
        self.costs = {i: max(1, round(-log * UNIT)) for i, log in logs.items()}
        self.byte_cost = max(self.costs.values()) + 10 * UNIT
        self.bytes = {vocabulary.id_to_piece(i): i for i in range(size) if vocabulary.is_byte(i)}
        self.byte_ids = [self.bytes[f"<0x{b:02X}>"] for b in range(256)]
        self.pieces = {vocabulary.id_to_piece(i).replace("▁", " "): i for i in plain}
        if any(re.search("[^ ] ", p) or ("\n" in p and p != "\n") for p in self.pieces):
            raise ValueError("a piece of the vocabulary goes over the start of a word")
        # Every start of a piece; those that are pieces have ids and cost.
        self.steps = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.steps.update({p: ((i,), self.costs[i]) for p, i in self.pieces.items()})
        self.spelled = [b""] * size
        for piece, i in self.pieces.items():
            self.spelled[i] = piece.encode()
        for b, i in enumerate(self.byte_ids):
            self.spelled[i] = bytes([b])
        self.most = most
        self.forget()

    def forget(self) -> None:
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> int:
                ids, cost, extra = outer.best(word)
                outer.flat.extend(ids)
                outer.ends.append(len(outer.flat))
                outer.cost.append(cost)
                outer.extra.append(extra)
                at = self[word] = len(outer.cost) - 1
                return at

        self.words, self.flat, self.ends = Words(), array("i"), array("q", [0])
        self.cost, self.extra = array("q"), array("d")

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """Per start: (end, ids, cost)."""
        steps, n, out = self.steps, len(word), []
        for i in range(n):
            own = []
            # U+2581 stands for a blank in the vocabulary, so no start has it; in a text it is spelled in bytes.
            for j in range(i + 1, n + 1):
                step = steps.get(word[i:j], False)
                if step:
                    own.append((j, *step))
                elif step is False:
                    break
            if not own or own[0][0] > i + 1:
                raw = word[i].encode("utf-8", "surrogatepass")
                own.append((i + 1, tuple(self.byte_ids[b] for b in raw), self.byte_cost * len(raw)))
            out.append(own)
        return out

    def forward(self, edges: list) -> tuple[list[float], list]:
        """Least cost to each position and the edge that it comes by."""
        least, came = [0] + [math.inf] * len(edges), [None] * (len(edges) + 1)
        for i, own in enumerate(edges):
            before = least[i]
            for j, ids, cost in own:
                if before + cost < least[j]:
                    least[j], came[j] = before + cost, (i, ids)
        return least, came

    def best(self, word: str) -> tuple[list[int], int, float]:
        """Ids and cost of the best path, and how much the second best costs more (infinite if there is none)."""
        edges = self.edges(word)
        least, came = self.forward(edges)
        at = n = len(edges)
        path, goes = [], [0] * n
        while at:
            i, ids = came[at]
            goes[i] = at
            path.append(ids)
            at = i
        total, second, rest = least[n], math.inf, [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            low, before, on_path = math.inf, least[i], goes[i]
            for j, _, cost in edges[i]:
                after = cost + rest[j]
                if after < low:
                    low = after
                if before + after < second and j != on_path:
                    second = before + after
            rest[i] = low
        return [k for ids in reversed(path) for k in ids], total, second - total

    def n_best(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """(cost, ids) of the ``n`` best paths: A-star from the end, the forward costs being the heuristic."""
        edges = self.edges(word)
        least, _ = self.forward(edges)
        coming: list[list] = [[] for _ in range(len(edges) + 1)]
        for i, own in enumerate(edges):
            for j, ids, cost in own:
                coming[j].append((i, ids, cost))
        heap, count, out = [(least[-1], len(edges), 0, 0, None)], itertools.count(1), []
        while heap and len(out) < n:
            total, at, _, done, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((total, ids))
                continue
            for i, ids, cost in coming[at]:
                heapq.heappush(heap, (least[i] + cost + done, i, next(count), cost + done, (ids, path)))
        return out

    def split(self, text: str) -> list[str]:
        return WORD.findall(" " + text) if text else []

    def encode(self, texts: list[str], n: int):
        """Per text: ids of the best segmentation, costs of the ``n`` best, and how those after the first differ."""
        if len(self.words) > self.most:
            self.forget()
        split = [self.split(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        cost, extra = (np.frombuffer(a, a.typecode) if len(a) else np.zeros(0, a.typecode) for a in (self.cost, self.extra))
        lengths = (ends[1:] - ends[:-1])[at] if len(at) else at
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(ends[at] - before[:-1], lengths) + np.arange(before[-1])] if len(at) else flat[:0]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ranked = [self.rank(split[k], at[a:b], cost, extra, lengths[a:b], n) for k, (a, b) in enumerate(zip(stops[:-1], stops[1:]))]
        return ids, before[stops], ranked

    def rank(self, words: list[str], at: np.ndarray, cost: np.ndarray, extra: np.ndarray, lengths: np.ndarray, n: int):
        total, more = int(cost[at].sum()), extra[at]
        open_ = np.flatnonzero(np.isfinite(more))
        chosen = np.sort(open_[np.argsort(more[open_], kind="stable")[: n - 1]])
        options = [self.n_best(words[c], n) for c in chosen]
        sums = [
            (sum(o[k][0] - o[0][0] for o, k in zip(options, ranks)), tuple(-k for k in ranks), ranks)
            for ranks in itertools.product(*(range(len(o)) for o in options))
        ]
        costs, changes = [], []
        for rank, (extra_cost, _, ranks) in enumerate(sorted(sums)[:n]):
            costs.append(total + extra_cost)
            for c, o, k in zip(chosen.tolist(), options, ranks):
                if k:
                    changes.append({"rank": rank, "start": int(lengths[:c].sum()), "length": int(lengths[c]), "ids": o[k][1]})
        return costs, changes


CHANGE = pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32()))])


def apply_changes(ids: list[int], changes: list, rank: int) -> list[int]:
    """Ids of the segmentation with this rank (0 is the best)."""
    out, at = [], 0
    for change in sorted((c for c in changes if c["rank"] == rank), key=lambda c: c["start"]):
        out += ids[at : change["start"]] + list(change["ids"])
        at = change["start"] + change["length"]
    return out + ids[at:]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> DataFrame:
    """One row per text: id, ``ids`` of the best segmentation, ``costs`` of the ``n`` best (fewer if there are
    fewer), and ``changes``: which runs of the best ids the others replace. One pass, no shuffle."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(f"pieces {model}")
        lattice = worker_memo(f"pieces {model}", lambda: Lattice(model))
        for batch in in_slices(batches, most_bytes=SLICE_BYTES):
            texts = [t.decode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            ids, ends, ranked = lattice.encode(texts, n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array([r[0] for r in ranked], pa.list_(pa.int64())),
                    pa.array([r[1] for r in ranked], pa.list_(CHANGE)),
                ],
                ["id", "ids", "costs", "changes"],
            )

    rows = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, costs array<long>, changes array<struct<rank:int,start:long,length:long,ids:array<int>>>"
    return rows.mapInArrow(segment, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The rows of ``rows`` with the text of ``ids_col`` in place of the ids."""
    others = [c for c in rows.columns if c != ids_col]
    picked = rows.select(*others, ids_col)
    schema = picked.drop(ids_col).schema.add(out_col, "string")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(f"spelling {model}")
        spelled = worker_memo(f"spelling {model}", lambda: Lattice(model).spelled)
        for batch in batches:
            column, start = batch.column(len(others)), 0
            upto = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            # Ids become Python numbers, many times their size, so only so many at a time.
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_IDS, "right")))
                texts = [b"".join(map(spelled.__getitem__, ids or ())) for ids in column.slice(start, end - start).to_pylist()]
                texts = [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())], [*others, out_col])
                start = end

    return picked.mapInArrow(spell, schema)
