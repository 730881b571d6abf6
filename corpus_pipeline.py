"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, packing.

Each stage takes what its predecessor kept, as a written table. The first
three return documents with all their columns; the last returns the packed pieces.
Rows of equal id are one document for the join and the verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.catalog.registry import read
from rowmill.llm import grades, line_rules, near_copies, packing
from rowmill.llm.queries import grade_of_labels, vocabulary
from rowmill.llm.words import fresh_driver
from rowmill.session import scratch_dir

# SQL cannot say what the trained models decide.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose base rules hold and whose content lines have enough of the words."""
    fresh_driver(spark)
    chain = line_rules.train(docs, read(spark, sf_dir, "labels"))
    return line_rules.keep_content(docs, line_rules.Rules(chain))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of the top grade more likely than not."""
    fresh_driver(spark)
    model = grades.train(docs, read(spark, sf_dir, "labels"), grade_of_labels(), 3)
    return grades.keep_graded(docs, grades.Grader(model))


def near_copy_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, one row of it; rows without an id all stay.

    Of rows of equal id the one with the least hash of all its values stays, so a task that runs again picks the same.
    """
    fresh_driver(spark)
    groups = near_copies.link_copies(docs)
    stays = groups.where("doc_id = component_id").groupBy("doc_id").count()
    repeated = stays.where("count > 1").select("doc_id")
    gone = groups.where("doc_id != component_id").select("doc_id").union(repeated)
    single = docs.join(gone, "doc_id", "left_anti")
    copies = docs.join(repeated, "doc_id", "left_semi")
    place = F.struct(F.xxhash64(*docs.columns), "text")
    one_each = copies.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), place).alias("row")).select("row.*")
    return single.select(docs.columns).union(one_each.select(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 2048 tokens."""
    fresh_driver(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), word_bytes=60_000_000)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copy_groups),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_dir(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
