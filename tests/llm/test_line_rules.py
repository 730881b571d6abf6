"""Quality rules: base counts, decoding and gradients against brute force, verdicts on documents."""

import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmill.llm import line_rules
from rowmill.llm.line_rules import N_FEATURES, Chain, Rules, fit_chain, log_likelihood

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
OPEN = Rules(Chain(np.eye(1, N_FEATURES)[0], np.zeros((2, 2))))
TEXTS = st.text(alphabet=st.sampled_from("abé# \t\n\r\x0b\x1c\x85|<AB!."), max_size=80)


def base(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_base_counts(text):
    assert OPEN.judge(text.encode())[:5] == base(text)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10**6))
def test_decoding_finds_the_best_labels(n, seed):
    rng = np.random.default_rng(seed)
    chain = Chain(rng.normal(size=N_FEATURES), rng.normal(size=(2, 2)))
    x = rng.random((n, N_FEATURES))

    def score(labels):
        own = sum(float(x[i] @ chain.weights) for i in range(n) if labels[i])
        return own + sum(chain.moves[a, b] for a, b in zip(labels, labels[1:]))

    best = max(itertools.product((0, 1), repeat=n), key=score)
    assert abs(score(chain.decode(x)) - score(best)) < 1e-9
    total = np.logaddexp.reduce([score(s) for s in itertools.product((0, 1), repeat=n)])
    padded, mask = np.zeros((1, n + 2, N_FEATURES)), np.zeros((1, n + 2), bool)
    padded[0, :n], mask[0, :n] = x, True
    value, dw, dm = log_likelihood(chain, padded, mask, np.array([1]))
    assert abs(value - (score((1,) * n) - total)) < 1e-9
    step = 1e-6
    moved = Chain(chain.weights + step * np.eye(1, N_FEATURES, 3)[0], chain.moves)
    assert abs((log_likelihood(moved, padded, mask, np.array([1]))[0] - value) / step - dw[3]) < 1e-3
    moved = Chain(chain.weights, chain.moves + step * np.array([[0, 0], [1, 0]]))
    assert abs((log_likelihood(moved, padded, mask, np.array([1]))[0] - value) / step - dm[1, 0]) < 1e-3


def test_one_grade_means_content():
    chain = fit_chain([(np.random.default_rng(0).random((5, N_FEATURES)), 1)])
    assert chain.decode(np.eye(1, N_FEATURES)) == [1]
    assert fit_chain([]).decode(np.eye(1, N_FEATURES)) == [1]


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "word " * 60, "x" * 100_000, "a b c " * 30]
    docs = spark.createDataFrame(
        [(k if k else None, t, "w", "id") for k, t in enumerate([*texts, texts[3]])], "doc_id long, text string, labels string, id string"
    )
    found = line_rules.label_lines(docs, OPEN).orderBy("n_words").collect()
    assert len(found) == 7
    for r in found:
        text = texts[3] if r.doc_id == 6 else texts[r.doc_id or 0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert line_rules.label_lines(docs.limit(0), OPEN).collect() == []
    kept = line_rules.keep_content(docs, OPEN)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in found)
    chain = line_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert chain.decode(np.eye(1, N_FEATURES)) == [1]


def test_documents(spark):
    from rowmill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    for r in docs:
        f = found[r.doc_id]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == base(r.text)
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [found[r.doc_id] for r in labels if r.quality == 1]
    bad = [found[r.doc_id] for r in labels if r.quality == 0]
    assert all(f.kept for f in good if not f.base_failed)
    assert sum(f.kept for f in bad) <= 0.05 * len(bad)


def test_training_lines_come_from_the_whole_text():
    lines = list(range(10_000))
    assert line_rules.spread_lines(lines[:256], 256, 1) == lines[:256]
    picked = [line_rules.spread_lines(lines, 256, seed) for seed in range(200)]
    assert all(len(p) <= 256 and p == sorted(p) and len(p) > 220 for p in picked)
    assert picked[3] == line_rules.spread_lines(lines, 256, 3) != picked[4]
    seen = {n for p in picked for n in p}
    assert max(seen) > 9_900 and min(seen) < 100 and len(seen) > 9_000


def test_training_holds_no_value_as_a_python_number(spark, monkeypatch):
    """2.6 MB of features as stored; as Python's numbers they took over 20 MB of the driver."""
    import tracemalloc

    text = "\n".join(f"line {i} of a text, as it is" for i in range(256))
    docs = spark.createDataFrame([(i, text) for i in range(180)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(180)], "doc_id long, quality int")
    monkeypatch.setattr(line_rules, "fit_chain", lambda documents: documents)
    line_rules.train(docs, labels)
    tracemalloc.start()
    try:
        documents = line_rules.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [f.shape for f, _ in documents] == [(256, line_rules.N_FEATURES)] * 180
    assert [g for _, g in documents] == [0, 1] * 90
    assert peak < 15_000_000
