"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score: ``P(grade >= k) = sigmoid(score - threshold[k])``.
The expected grade is the sum of these tail probabilities, and the tail
probability of the top grade selects documents.

Features are a text's distinct words, the first four bytes of longer ones, and a few
words that stand for its shape (share of distinct words, of symbols, of capitals, word
length), hashed into a fixed number of weights. Of the sample's features those count that
go with the grade by a chi-square test. The fit uses a bounded sample of labelled rows; the
score covers whole texts of all rows in one pass without a shuffle.

Null and empty texts have shape features only. Without two grades in the sample
nothing can be learned, and every document gets the only grade there is (the top
grade if there is none). Repeated ids are separate rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.line_rules import SYMBOLS, UPPER
from rowmill.llm.words import fresh_worker, in_order, keep_rows, labelled_sample, list_cells, select_text

CHI_SQUARE = 12
EDGES = b".,;:!?\"'()[]"


def shape_words(text: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """Features of the whole text, spelled so that no word of a text equals them."""
    n, size = len(words), len(text)
    if not n:
        return [b"\x00empty"]
    symbols = size - len(text.translate(None, SYMBOLS))
    upper = size - len(text.translate(None, UPPER))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    shapes = {
        b"varied": distinct / math.sqrt(n) * 1.5,
        b"symbols": 10 * math.sqrt(symbols / n),
        b"upper": 10 * math.sqrt(upper / size),
        b"bangs": 10 * math.sqrt(text.count(b"!") / n),
        b"again": 10 * math.sqrt(repeats / n),
        b"letters": size / n,
        b"length": math.log2(n),
    }
    return [b"\x00%s=%d" % (name, min(20, int(value))) for name, value in shapes.items()]


def slot(word: bytes, bits: int) -> int:
    return zlib.crc32(word if word[:1] in (b"\x00", b"\x01") else word.strip(EDGES)) & ((1 << bits) - 1)


def text_words(text: bytes) -> set[bytes]:
    """Distinct lower-cased words of a text, their beginnings, and its shape words."""
    words = text.lower().split()
    distinct = set(words)
    starts = {b"\x01" + w[:4] for w in distinct if len(w) > 4}
    return distinct.union(starts, shape_words(text, words, len(distinct)))


def telling(slots: list[np.ndarray], grades: np.ndarray, n_grades: int, n_slots: int, least: int = 5) -> np.ndarray:
    """Which features go with the grade: at some threshold, presence and tail are not independent.

    The bound is the same for samples of any size.
    """
    n, flat = len(slots), np.concatenate(slots)
    owner = np.repeat(np.arange(n), list(map(len, slots)))
    have = np.bincount(flat, minlength=n_slots).astype(float)
    found = np.zeros(n_slots, bool)
    for k in range(1, n_grades):
        above = grades >= k
        both = np.bincount(flat[above[owner]], minlength=n_slots)
        wanted = have * above.mean()
        spread = have * (1 - have / n) * above.mean() * (1 - above.mean())
        found |= (both - wanted) ** 2 > CHI_SQUARE * np.maximum(spread, 1e-12)
    return found & (have >= least)


class Ordinal:
    """Shared weights and ordered thresholds; grade 0 has no threshold."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    def tails(self, score: float) -> list[float]:
        """``P(grade >= 1), P(grade >= 2), ...``"""
        return [1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, score - t)))) for t in self.thresholds.tolist()]


def fit_ordinal(slots: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, rounds: int = 24, rate: float = 0.1, penalty: float = 2e-4) -> Ordinal:
    """Stochastic gradient ascent with per-weight steps on the cumulative-link likelihood."""
    weights = np.zeros(1 << bits)
    seen = sorted(set(grades.tolist())) or [n_grades - 1]
    if len(seen) < n_grades:
        # A grade without rows has no threshold of its own: it shares that of the next grade with rows.
        fitted = fit_ordinal(slots, np.searchsorted(seen, grades), len(seen), bits, rounds, rate, penalty) if len(seen) > 1 else Ordinal(weights, np.zeros(0), bits)
        bounds = [-500.0, *fitted.thresholds.tolist(), 500.0]
        return Ordinal(fitted.weights, np.array([bounds[np.searchsorted(seen, k)] for k in range(1, n_grades)]), bits)
    used = telling(slots, grades, n_grades, 1 << bits)
    slots = [s[used[s]] for s in slots]
    tail = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    thresholds = -np.log(tail / (1 - tail))
    past, past_t = np.full(1 << bits, 1e-2), np.full(n_grades - 1, 1e-2)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(slots)):
            s, g = slots[i], grades[i]
            z = weights[s].sum() - np.concatenate([[-1e3], thresholds, [1e3]])
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
            slope = p * (1 - p)
            share = max(p[g] - p[g + 1], 1e-9)
            d_low, d_high = slope[g] / share, slope[g + 1] / share
            step = (d_low - d_high) - penalty * weights[s]
            past[s] += step**2
            weights[s] += rate * step / np.sqrt(past[s])
            if g > 0:
                past_t[g - 1] += d_low**2
                thresholds[g - 1] -= rate * d_low / math.sqrt(past_t[g - 1])
            if g < n_grades - 1:
                past_t[g] += d_high**2
                thresholds[g] += rate * d_high / math.sqrt(past_t[g])
            thresholds = np.maximum.accumulate(thresholds)
    return Ordinal(weights, thresholds, bits)


def train(
    docs: DataFrame,
    labels: DataFrame,
    grade: Column,
    n_grades: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 10_000,
    bits: int = 18,
) -> Ordinal:
    """Fit on at most ``most`` labelled documents; ``grade`` is 0 to ``n_grades - 1`` or null (left out)."""
    graded = labels.select(F.col(id_col), grade.cast("int").alias("grade")).where("grade IS NOT NULL")
    rows = select_text(docs, id_col, text_col).join(labelled_sample(graded, id_col, "grade", most=most), "id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            found = [sorted({slot(w, bits) for w in text_words(t)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], ["id", "grade", "slots"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.mapInArrow(featurise, f"id {kind}, grade int, slots array<int>").toArrow()
    slots, grades = list_cells(sample.column("slots")), sample.column("grade").to_numpy().astype(int)
    order = in_order(sample.column("id").to_pylist(), slots)
    return fit_ordinal([slots[i].astype(int) for i in order], grades[order], n_grades, bits)


class Grader:
    """Scores texts; remembers the weights of at most ``most_words`` words, others are looked up again."""

    def __init__(self, model: Ordinal, min_tail: float = 0.5, most_words: int = 400_000):
        self.model, self.min_tail, self.most_words, self.known = model, min_tail, most_words, None

    def judge(self, text: bytes) -> tuple[float, float, float, bool]:
        """Score, expected grade, tail probability of the top grade, verdict."""
        if self.known is None:
            weights, bits, most = self.model.weights, self.model.bits, self.most_words

            class Known(dict):
                def __missing__(self, word: bytes) -> float:
                    weight = float(weights[slot(word, bits)])
                    if len(self) < most:
                        self[word] = weight
                    return weight

            self.known = Known()
        score = math.fsum(map(self.known.__getitem__, text_words(text)))
        tails = self.model.tails(score)
        return score, sum(tails), tails[-1], tails[-1] >= self.min_tail


def grade_documents(docs: DataFrame, grader: Grader, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: score, expected grade, tail probability of the top grade, verdict."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [grader.judge(text.as_py()) for text in batch.column("text")]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, [pa.float64()] * 3 + [pa.bool_()])]],
                ["id", "score", "expected_grade", "tail", "kept"],
            )

    rows = select_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(judge, f"id {kind}, score double, expected_grade double, tail double, kept boolean")
    return found.withColumnRenamed("id", id_col)


def keep_graded(docs: DataFrame, grader: Grader, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are."""
    return keep_rows(docs, text_col, lambda text: grader.judge(text)[-1])
