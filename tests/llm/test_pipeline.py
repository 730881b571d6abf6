"""The corpus pipeline: every stage against a loop, odd rows, empty tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowmill.llm import grades, line_rules
from rowmill.llm.queries import grade_of_labels
from rowmill.llm.shingles import exact_shingles

FOLDER = os.environ.get("ROWMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, over the table with odd rows and clashing names added."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    odd = odd.union(docs.limit(2)).union(docs.where("doc_id = 5").withColumn("text", F.concat("text", F.lit(" changed at the end"))))
    odd = odd.union(docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    docs = docs.union(odd).withColumns({"id": F.lit("x"), "_text_bytes": F.lit(1), "queue": F.lit("q"), "kept": F.lit(None).cast("int")})
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs.write.parquet(f"{folder}/0")
    out = [spark.read.parquet(f"{folder}/0")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "n-gram Jaccard join", "packing"]


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:4])


def test_rules_equal_a_loop(spark, stages):
    rules = line_rules.Rules(line_rules.train(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet")))
    expected = [r for r in stages[0].collect() if rules.judge((r["text"] or "").encode())[-1]]
    assert rows_of(stages[1]) == sorted(map(tuple, expected), key=repr)
    assert 0 < len(expected) < stages[0].count()


def test_classifier_equals_a_loop(spark, stages):
    grader = grades.Grader(grades.train(stages[1], spark.read.parquet(f"{FOLDER}/labels.parquet"), grade_of_labels(), 3))
    expected = [r for r in stages[1].collect() if grader.judge((r["text"] or "").encode())[-1]]
    assert rows_of(stages[2]) == sorted(map(tuple, expected), key=repr)


def test_one_document_of_each_group_stays(stages):
    given = [r for r in stages[2].collect()]
    sets = [(r["doc_id"], exact_shingles((r["text"] or "").encode().lower())) for r in given]
    parent = {key: key for key, _ in sets if key is not None}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    kept = [r["doc_id"] for r in stages[3].collect()]
    assert kept.count(None) == sum(key is None for key, _ in sets)
    assert sorted(k for k in kept if k is not None) == sorted({root(k) for k in parent})


def test_packing_holds_every_token_once(stages):
    pieces = stages[4].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert all(r["n"] <= 2048 for r in pieces)
    ids = {r["doc_id"] for r in stages[3].select("doc_id").collect()}
    assert {r["doc_id"] for r in stages[4].select("doc_id").collect()} == ids


def test_a_repeated_id_keeps_the_same_row_however_dealt(spark, stages):
    text = "one two three four five six seven eight nine ten " * 3
    base = stages[0].limit(1).drop("doc_id", "text")
    rows = spark.createDataFrame([(7, text + w) for w in ("a b", "c d", "e f", "g h")], "doc_id long, text string").crossJoin(base)
    docs = rows.select(stages[0].columns)
    found = {tuple(map(str, rows_of(corpus_pipeline.near_copy_groups(spark, docs.repartition(n), FOLDER)))) for n in (1, 3)}
    assert len(found) == 1 and len(next(iter(found))) == 1


def test_empty_table(spark):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
