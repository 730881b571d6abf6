import pytest
from pyspark.sql import functions as F

from rowmill.functions.numbers import floor_div
from rowmill.operators import paging, stats


def actions(spark):
    rows = [(f"a{i:03}", ["done", "failed", "queued", "processing"][i % 4], i // 8) for i in range(40)]
    return spark.createDataFrame(rows, "id string, status string, created_at int")


def test_priority_order_and_pages(spark):
    df = actions(spark)
    whole = [r["id"] for r in df.orderBy(*paging.by_priority()).collect()]
    pages = [r["id"] for n in range(1, 5) for r in paging.page(df, paging.by_priority(), n, 10).collect()]
    assert pages == whole
    assert whole[0] == "a035" and whole[:10] == [f"a{i:03}" for i in (35, 39, 27, 31, 19, 23, 11, 15, 3, 7)]
    plan = paging.page(df, paging.by_priority(), 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_keyset_pages_equal_offset_pages(spark):
    df = actions(spark)
    first = paging.page(df, paging.newest_first(), 1, 15).collect()
    after = paging.page_after(df, first[-1]["created_at"], first[-1]["id"], 15).collect()
    assert after == paging.page(df, paging.newest_first(), 2, 15).collect()


def test_page_meta_and_bounds(spark):
    df = actions(spark)
    meta = paging.page_meta(df, 4, 10).first()
    assert (meta["total"], meta["total_pages"], meta["has_next"], meta["has_prev"]) == (40, 4, False, True)
    assert paging.page_meta(df.filter("false")).first()["total_pages"] == 0
    for number, limit in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            paging.page(df, [F.col("id")], number, limit)


def test_filters_and_search(spark):
    df = spark.createDataFrame([("1", "Ann", "x@y.io"), ("2", "Bob", "ann@y.io"), ("3", None, "c@y.io")], "id string, name string, email string")
    assert paging.search_contacts(df, search="ANN").count() == 2
    assert paging.search_contacts(df, email="ANN@y.io").first()["id"] == "2"
    assert paging.where_equal(df, {"id": "1", "name": None, "nothing": 5}).count() == 1


def test_queue_health_limits(spark):
    def verdict(**counts):
        rows = [("q", state) for state, n in counts.items() for _ in range(n)]
        df = spark.createDataFrame(rows, "queue string, state string")
        row = stats.queue_health(df, limits={"processing": (8, 4)}).first()
        return row["status"], row["failure_rate"]

    assert verdict(completed=3) == ("healthy", 0.0)
    assert verdict(active=4, failed=1, completed=1) == ("healthy", 50.0)
    assert verdict(active=5) == ("degraded", 0.0)
    assert verdict(waiting=9) == ("unhealthy", 0.0)
    assert verdict(active=1, failed=1)[0] == "degraded"
    assert verdict(active=1, failed=2)[0] == "unhealthy"


def test_exact_percentiles(spark):
    df = spark.range(1, 101).select(F.lit("/e").alias("endpoint"), F.col("id").alias("duration_ms"), F.lit(False).alias("is_error"))
    row = stats.latency_objectives(df, apdex_ms=20).first()
    assert (row["p95_ms"], row["p99_ms"], row["satisfied"], row["tolerating"], row["apdex"]) == (95, 99, 20, 60, 0.5)
    assert row["meets_p95"] and row["meets_p99"] and row["meets_errors"]


def test_floor_div_is_exact(spark):
    values = [0, 1, 999, -1, -1000, -1001, 2**62 + 7, 9_007_199_254_740_993]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert {r["v"]: r["q"] for r in df.select("v", floor_div(F.col("v"), 1000).alias("q")).collect()} == {v: v // 1000 for v in values}
