"""Quality rules: a linear-chain conditional random field labels the lines of a text.

Every line that has a word is content or boilerplate. The chain's score of a
labelling is the sum of line features times weights, for lines labelled
content, plus a weight for each pair of neighbouring labels. Weights are the
maximum of the penalised likelihood over a bounded sample of labelled
documents; Viterbi decoding finds the best labelling of each whole text, and the
share of words in content lines decides.

Training lines carry their document's quality grade: lines of good documents
are content, lines of bad ones boilerplate. Without documents of both grades
nothing can be learned and every line counts as content.

Null and empty texts have no line and no word; they fail the base rules.
Repeated ids are separate rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.shingles import mix
from rowmill.llm.words import BLANKS, fresh_worker, in_order, keep_rows, labelled_sample, list_cells, select_text

# The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
CONTINUED = bytes(range(128, 192))
N_FEATURES = 14
# Lines that the chain is trained on in a row.
RUN = 32


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    """Features of one line; each lies in [0, 1]."""
    n, size = len(words), len(line)
    distinct = len(set(words))
    letters = size - len(line.translate(None, LETTERS))
    upper = size - len(line.translate(None, UPPER))
    symbols = size - len(line.translate(None, SYMBOLS))
    last = line.rstrip()[-1:]
    return [
        1.0,
        float(n <= 2),
        float(3 <= n <= 8),
        float(n > 30),
        min(1.0, 4.0 * symbols / n),
        float(symbols > n),
        upper / letters if letters else 0.0,
        float(letters > 0 and 2 * upper > letters),
        1.0 - distinct / n,
        float(n >= 4 and 2 * distinct < n),
        float(seen),
        float(last in (b".", b"?", b"!", b'"')),
        min(1.0, 4.0 * line.count(b"!") / n),
        min(1.0, (size - len(line.translate(None, DIGITS))) / n),
    ]


def text_features(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of them repeat an earlier one."""
    features, sizes, seen, repeated = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeated += again
            seen.add(line)
            features.append(line_features(line, words, again))
            sizes.append(len(words))
    return features, sizes, repeated


class Chain:
    """Two labels, 0 boilerplate and 1 content: ``weights`` of content, ``moves[from, to]``."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, features: np.ndarray) -> list[int]:
        """Best labelling of the lines; of equal ones, the one with content."""
        if not len(features):
            return []
        scores = (features @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.moves.tolist()
        bad, good, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_b = (bad + bb > good + cb, bad + bc > good + cc)
            bad, good = max(bad + bb, good + cb), max(bad + bc, good + cc) + s
            back.append(from_b)
        label = int(good >= bad)
        labels = [label]
        for from_b in reversed(back):
            label = 0 if from_b[label] else 1
            labels.append(label)
        return labels[::-1]


def log_likelihood(chain: Chain, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Log-likelihood of label sequences (padded; ``mask`` marks lines) and its gradients."""
    n, steps, _ = x.shape
    score = np.zeros((n, steps, 2))
    score[:, :, 1] = x @ chain.weights
    ahead = np.zeros((n, steps, 2))
    ahead[:, 0] = score[:, 0]
    for t in range(1, steps):
        step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + chain.moves[None], axis=1) + score[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    behind = np.zeros((n, 2))
    d_moves, expected = np.zeros((2, 2)), np.zeros((n, steps))
    for t in range(steps - 1, -1, -1):
        here = np.exp(ahead[:, t] + behind - total[:, None])
        expected[:, t] = np.where(mask[:, t], here[:, 1], 0.0)
        if t:
            pair = ahead[:, t - 1, :, None] + chain.moves[None] + (score[:, t] + behind)[:, None, :]
            on = mask[:, t]
            seen = np.exp(pair[on] - total[on, None, None]).sum(axis=0)
            true = np.zeros((2, 2))
            np.add.at(true, (y[on], y[on]), 1.0)
            d_moves += true - seen
            behind = np.where(on[:, None], np.logaddexp.reduce(pair - ahead[:, t - 1, :, None], axis=2), behind)
    gold = np.where(mask, y[:, None], 0.0)
    d_weights = ((gold - expected)[:, :, None] * x).sum(axis=(0, 1))
    value = (gold * score[:, :, 1]).sum() + (mask[:, 1:].sum(axis=1) * chain.moves[y, y]).sum() - total.sum()
    return value, d_weights, d_moves


def fit_chain(documents: list[tuple[np.ndarray, int]], steps: int = RUN, rounds: int = 60, penalty: float = 1.0) -> Chain:
    """Weights from (line features, grade) pairs; long documents are cut into runs of ``steps`` lines."""
    runs = [(f[i : i + steps], g) for f, g in documents for i in range(0, len(f), steps)]
    grades = {g for _, g in runs}
    if len(grades) < 2:
        always = np.zeros(N_FEATURES)
        always[0] = 1.0
        return Chain(always, np.zeros((2, 2)))
    x = np.zeros((len(runs), steps, N_FEATURES))
    mask = np.zeros((len(runs), steps), bool)
    for i, (f, _) in enumerate(runs):
        x[i, : len(f)] = f
        mask[i, : len(f)] = True
    y = np.array([g for _, g in runs])
    chain = Chain(np.zeros(N_FEATURES), np.zeros((2, 2)))
    params, mean, square = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for k in range(1, rounds + 1):
        _, dw, dm = log_likelihood(chain, x, mask, y)
        gradient = np.concatenate([dw, dm.ravel()]) / len(runs) - penalty * params / len(runs)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        params = params + 0.25 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        chain = Chain(params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2))
    return chain


def spread_lines(lines: list, most_lines: int, seed: int) -> list:
    """The lines, or of a long text runs of lines picked by hash from its whole length; a run has ``RUN`` lines."""
    runs = -(-len(lines) // RUN)
    if runs <= most_lines // RUN:
        return lines
    order = np.argsort(mix(np.arange(runs, dtype=np.uint64) ^ np.uint64(seed)))[: most_lines // RUN]
    return [line for k in np.sort(order).tolist() for line in lines[k * RUN : (k + 1) * RUN]]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "quality",
    most: int = 2000,
    most_lines: int = 256,
) -> Chain:
    """Fit the chain on at most ``most`` labelled documents, ``most_lines`` lines of each, from its whole length.

    Grade 0 is bad, larger grades are good, null grades are left out.
    """
    sample = labelled_sample(labels.where(F.col(grade_col).isNotNull()), id_col, grade_col, most=most)
    rows = select_text(docs, id_col, text_col).join(sample.withColumnRenamed(grade_col, "grade"), "id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            ids, texts, grades = (batch.column(c).to_pylist() for c in ("id", "text", "grade"))
            lines = (spread_lines(text_features(t)[0], most_lines, xxhash.xxh64_intdigest(str(i))) for i, t in zip(ids, texts))
            flat = [np.asarray(own, "f4").ravel().tolist() for own in lines]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([int(g > 0) for g in grades], pa.int32()), pa.array(flat, pa.list_(pa.float32()))],
                ["id", "grade", "features"],
            )

    found = rows.select(F.col("id").cast("long").alias("id"), "text", "grade").mapInArrow(
        featurise, "id long, grade int, features array<float>"
    )
    sample = found.toArrow()
    features, grades = list_cells(sample.column("features")), sample.column("grade").to_pylist()
    order = in_order(sample.column("id").to_pylist(), features)
    return fit_chain([(features[i].astype(float).reshape(-1, N_FEATURES), grades[i]) for i in order if len(features[i])])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


RULE_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_words long, content_share double, labels string, kept boolean"
)


class Rules:
    """The trained chain and the limits of the verdict.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of them in repeated three-word windows.
    ``kept``: the base rules hold and at least ``min_share`` of the words lie in
    content lines.
    """

    def __init__(self, chain: Chain, min_share: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50):
        self.chain, self.min_share, self.min_words, self.max_repeat_percent = chain, min_share, min_words, max_repeat_percent

    def judge(self, text: bytes) -> tuple:
        """The values of ``RULE_COLUMNS`` for one text."""
        words = text.split()
        n = len(words)
        chars = len(text.translate(None, CONTINUED + BLANKS))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        repeats = repeat_words(words)
        features, sizes, repeated = text_features(text)
        labels = self.chain.decode(np.asarray(features, float)) if features else []
        content = sum(s for s, label in zip(sizes, labels) if label)
        failed = n < self.min_words or 100 * repeats > self.max_repeat_percent * n
        share = content / n if n else 0.0
        shown = "".join("c" if label else "b" for label in labels)
        return n, chars, symbols, repeated, repeats, failed, content, share, shown, not failed and share >= self.min_share


def label_lines(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, line labels (``c``/``b`` per line with a word), verdict.

    One pass over the rows, no shuffle.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [rules.judge(text.as_py()) for text in batch.column("text")]
            columns = list(zip(*out)) if out else [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["id", *[c.split()[0] for c in RULE_COLUMNS.split(", ")]],
            )

    rows = select_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"id {kind}, {RULE_COLUMNS}").withColumnRenamed("id", id_col)


def keep_content(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    return keep_rows(docs, text_col, lambda text: rules.judge(text)[-1])
