import hashlib

import pytest
from pyspark.sql import functions as F

from rowmill.functions import ring
from rowmill.operators import chunking

SPACE = 2**64 - 1


@pytest.mark.parametrize("n", [1, 3, 37, 100, 1000])
def test_index_equals_integer_arithmetic(spark, n):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("id"))
    for count in (n, F.lit(n)):
        found = df.select("id", ring.chunk_index(F.col("id"), count).alias("i")).collect()
        for row in found:
            h = int(hashlib.sha256(row["id"].encode()).hexdigest()[:16], 16)
            assert row["i"] == min(h // (SPACE // n), n - 1)


@pytest.mark.parametrize("n", [1, 3, 100, 1000])
def test_ranges_cover_the_space(spark, n):
    expected = ring.ring_ranges(n)
    found = spark.range(n).select(
        F.col("id").cast("int").alias("i"),
        ring.range_start(F.col("id").cast("int"), n).alias("s"),
        ring.range_end(F.col("id").cast("int"), n).alias("e"),
        ring.range_start(F.col("id").cast("int"), F.lit(n)).alias("s2"),
        ring.range_end(F.col("id").cast("int"), F.lit(n)).alias("e2"),
    ).orderBy("i").collect()
    assert [(r["i"], r["s"], r["e"]) for r in found] == expected
    assert [(r["i"], r["s2"], r["e2"]) for r in found] == expected
    assert expected[0][1] == "0" * 16 and expected[-1][2] == "f" * 16
    for (_, _, end), (_, start, _) in zip(expected, expected[1:]):
        assert int(end, 16) + 1 == int(start, 16)


def test_top_hash_is_clamped(spark):
    top = F.lit("ffffffffffffffff")
    index = F.call_function("div", F.conv(top, 16, 10).cast("decimal(20,0)"), ring.range_width(3))
    assert spark.range(1).select(index.alias("i")).first()["i"] == 3  # one past the last range, so the clamp matters


def test_skipped_rows_leave_and_keyless_rows_are_reported(spark):
    df = spark.createDataFrame(
        [(1, "a", "keep"), (2, "b", "skip"), (3, "c", "review"), (4, "  ", "keep"), (5, None, "keep")],
        "row_number long, id string, action string",
    )
    assigned = chunking.assign_chunks(df, chunking.ChunkOptions(chunks=4))
    assert {r["row_number"] for r in assigned.collect()} == {1, 3, 4, 5}
    assert {r["row_number"] for r in chunking.unassigned_rows(assigned).collect()} == {4, 5}


def test_metadata_adds_up(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("row_number"), F.col("id").cast("string").alias("id"))
    options = chunking.ChunkOptions(chunks=7, naming="hash_range")
    meta = chunking.chunk_metadata(chunking.assign_chunks(df, options), options).collect()
    assert sum(r["record_count"] for r in meta) == 2000 and len(meta) == 7
    assert all(r["file_name"] == f"chunk_{r['hash_range_start']}-{r['hash_range_end']}.csv" for r in meta)


def test_plan_and_option_checks(spark):
    for rows, chunks, size in ((0, 1, 1), (1, 1, 1), (1000, 1, 1000), (1001, 2, 501), (250_000, 250, 1000), (10**10, 10**7, 1000)):
        plan = spark.range(1).select(*[c.alias(k) for k, c in chunking.plan_chunks(F.lit(rows), 1000).items()]).first()
        assert (plan["chunks"], plan["max_rows"]) == (chunks, size)
        assert chunking.plan_options(rows, 1000).chunks == chunks
    for bad in ({"chunks": 0}, {"chunks": 1, "field": " "}, {"chunks": 1, "naming": "x"}):
        with pytest.raises(ValueError):
            chunking.ChunkOptions(**bad)


def test_balance_verdicts(spark):
    even = spark.createDataFrame([(0, "0", "1", 10), (1, "2", "3", 10)], "chunk_index int, hash_range_start string, hash_range_end string, record_count long")
    assert chunking.chunk_balance(chunking.chunk_distribution(even)).first()["is_balanced"]
    skewed = even.withColumn("record_count", F.when(F.col("chunk_index") == 0, 1).otherwise(100).cast("bigint"))
    assert len(chunking.chunk_balance(chunking.chunk_distribution(skewed)).first()["issues"]) == 2
    empty = chunking.chunk_balance(chunking.chunk_distribution(even.filter("false"))).first()
    assert empty["issues"] == [chunking.ISSUE_EMPTY]


def test_jobs_are_listed_whole(spark):
    from rowmill.catalog import QUERIES
    from rowmill.catalog.chunks import N

    rows = QUERIES["chunk_jobs"](spark, "/root/testdata/sf0.001").collect()
    jobs = [(r.partition_id, int(i)) for r in rows for i in r.chunk_indexes.split(",")]
    assert len(jobs) == sum(r.jobs for r in rows) and {i for _, i in jobs} <= set(range(N))
    assert all(r.chunk_indexes.split(",") == sorted(r.chunk_indexes.split(","), key=int) for r in rows)
    single = QUERIES["chunk_job_rows"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(jobs) == sorted((r.partition_id, r.chunk_index) for r in single)
    assert sum(r.records for r in rows) == sum(r.record_count for r in single)
