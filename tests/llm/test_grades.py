"""Quality classifier: gradients' fixed points, probabilities and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from rowmill.llm import grades
from rowmill.llm.grades import Grader, Ordinal, fit_ordinal
from rowmill.llm.queries import grade_of_labels


def test_thresholds_are_ordered_and_fit():
    rng = np.random.default_rng(1)
    slots, truth = [], []
    for _ in range(900):
        level = rng.integers(3)
        slots.append(np.unique(np.concatenate([rng.integers(10, 60, 5), [level]])))
        truth.append(level)
    model = fit_ordinal(slots, np.array(truth), 3, bits=6)
    assert model.thresholds[0] <= model.thresholds[1]
    scores = [model.weights[s].sum() for s in slots]
    found = [sum(p >= 0.5 for p in model.tails(z)) for z in scores]
    assert np.mean(np.array(found) == truth) > 0.95


def test_a_grade_without_rows():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 400) * 2
    slots = [np.unique([g, *rng.integers(5, 40, 4)]) for g in truth]
    model = fit_ordinal(slots, truth, 3, bits=6)
    assert model.thresholds[0] == model.thresholds[1]
    kept = [Grader(model).model.tails(model.weights[s].sum())[-1] >= 0.5 for s in slots]
    assert np.mean(np.array(kept) == (truth == 2)) > 0.95


def test_one_grade():
    for seen, expected in (([], 2.0), ([0, 0], 0.0), ([1, 1], 1.0)):
        model = fit_ordinal([np.array([1])] * len(seen), np.array(seen, int), 3, bits=4)
        assert abs(Grader(model).judge(b"any text")[1] - expected) < 1e-6


def test_odd_rows(spark):
    model = Ordinal(np.linspace(-1, 1, 1 << 8), np.array([-1.0, 1.0]), 8)
    docs = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.5), (3, "word " * 50_000, 0.5), (None, "no id", 0.5), (3, "word " * 50_000, 0.5)],
        "doc_id long, text string, score double",
    )
    found = grades.grade_documents(docs, Grader(model, most_words=1)).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "2", "3", "3", "None"]
    rows = {r.doc_id: r for r in found}
    assert rows[1][1:] == rows[2][1:]
    for r in found:
        assert abs(r.expected_grade - sum(model.tails(r.score))) < 1e-12
        assert r.kept == (r.tail >= 0.5)
    assert grades.grade_documents(docs.limit(0), Grader(model)).collect() == []
    assert grades.keep_graded(docs, Grader(model)).columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fitted = grades.train(docs, none, grade_of_labels(), 3)
    assert all(r.kept for r in grades.grade_documents(docs, Grader(fitted)).collect())


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("grade", grade_of_labels())
    held = F.pmod("doc_id", F.lit(4)) == 0
    model = grades.train(docs, labels.where(~held), F.col("grade"), 3)
    found = grades.grade_documents(docs, Grader(model)).join(labels.where(held), "doc_id").collect()
    right = [r.kept == (r.grade == 2) for r in found]
    clean = [r.kept for r in found if r.grade == 2]
    assert np.mean(right) > 0.97
    assert np.mean(clean) > 0.99
    assert np.mean([r.kept for r in found if r.grade == 0]) < 0.05
    mean = {g: np.mean([r.expected_grade for r in found if r.grade == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]


def test_rare_toxic_words_count_in_large_samples():
    rng = np.random.default_rng(6)
    n, rare = 9000, 40
    truth = rng.choice(3, n, p=[0.11, 0.3, 0.59])
    slots = [np.unique(rng.integers(100, 500, 12)) for _ in range(n)]
    toxic = np.flatnonzero(truth == 0)
    # Forty words that occur in eight toxic documents each and nowhere else.
    for k in range(rare):
        for i in toxic[8 * k : 8 * k + 8]:
            slots[i] = np.append(slots[i], k)
    assert grades.telling(slots, truth, 3, 512)[:rare].all()
    model = fit_ordinal(slots, truth, 3, bits=9)
    base = [model.weights[s].sum() for s in slots[-2000:]]
    with_word = [z + model.weights[k % rare] for k, z in enumerate(base)]
    assert np.mean([model.tails(z)[-1] >= 0.5 for z in base]) > 0.5
    assert np.mean([model.tails(z)[-1] >= 0.5 for z in with_word]) < 0.1
