import random

import pytest
from pyspark.sql import functions as F

from rowmill.operators import dedup

KEYS = ["A@x.io", " a@X.io ", None, "", "b@x.io", "  ", "B@x.io ", "c  d", "C\td", "  "]


def uploaded(spark, n=600, hot=True, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        key = "hot@x.io" if hot and i % 3 == 0 else rng.choice([*KEYS, f"k{rng.randint(0, 40)}"])
        rows.append((i, key, rng.choice(["", f"v{i}"])))
    return spark.createDataFrame(rows, "row_number long, email string, v string"), rows


def normal(key):
    if not key:
        return None
    return " ".join(key.replace(" ", " ").split()).lower()


def by_loop(rows, strategy):
    """Row by row with a dictionary, the plain reading of the strategies."""
    last = {normal(k): n for n, k, _ in rows}
    seen, first, out = {}, {}, {}
    for n, k, _ in rows:
        key = normal(k)
        if key is None:
            out[n] = ("keep", 1, None)
            continue
        seen[key] = seen.get(key, 0) + 1
        first.setdefault(key, n)
        if strategy == "keep_last":
            action = "keep" if last[key] == n else "skip"
        else:
            repeat = "review" if strategy == "mark_all" else "skip"
            action = "keep" if seen[key] == 1 else repeat
        out[n] = (action, seen[key], first[key])
    return out


@pytest.mark.parametrize("strategy", ["keep_first", "keep_last", "mark_all"])
@pytest.mark.parametrize("width", [7, 1_000_000])
def test_verdicts_equal_a_loop(spark, strategy, width):
    df, rows = uploaded(spark)
    marked = dedup.mark_duplicates(df, dedup.normalize_key(F.col("email")), strategy, slice_rows=width)
    found = {r["row_number"]: (r["action"], r["duplicate_count"], r["first_occurrence"]) for r in marked.collect()}
    assert found == by_loop(rows, strategy)


@pytest.mark.parametrize("strategy", ["keep_first", "keep_last"])
@pytest.mark.parametrize("long_keys", [False, True])
def test_survivors_equal_the_kept_verdicts(spark, strategy, long_keys):
    df, rows = uploaded(spark)
    key = dedup.normalize_key(F.col("email"))
    kept = {r["row_number"] for r in dedup.deduplicate(df, key, strategy, long_keys=long_keys).collect()}
    assert kept == {n for n, verdict in by_loop(rows, strategy).items() if verdict[0] == "keep"}


def test_result_does_not_depend_on_partitioning(spark):
    df, _ = uploaded(spark)
    key = dedup.normalize_key(F.col("email"))
    one = dedup.mark_duplicates(df.coalesce(1), key, slice_rows=50).collect()
    many = dedup.mark_duplicates(df.repartition(13, "v"), key, slice_rows=50).collect()
    assert sorted(one) == sorted(many)


def test_merge_takes_the_first_filled_cell(spark):
    df = spark.createDataFrame(
        [(1, "a", "", None), (2, "A ", "x", 5), (3, "a", "y", 6), (4, None, "", None), (5, "", "z", 1)],
        "row_number long, email string, v string, n int",
    )
    merged = dedup.merge_per_key(df, dedup.normalize_key(F.col("email"))).orderBy("row_number").collect()
    assert [(r["row_number"], r["v"], r["n"], r["merged_rows"]) for r in merged] == [
        (1, "x", 5, 3),
        (4, None, None, 1),
        (5, "z", 1, 1),
    ]
    latest = dedup.merge_per_key(df, dedup.normalize_key(F.col("email")), prefer="last").orderBy("row_number").first()
    assert (latest["v"], latest["n"]) == ("y", 6)


def test_histogram_buckets(spark):
    rows, n = [], 0
    for key, copies in (("a", 1), ("b", 2), ("c", 3), ("d", 5), ("e", 6), (None, 4)):
        for _ in range(copies):
            n += 1
            rows.append((n, key))
    df = spark.createDataFrame(rows, "row_number long, email string")
    row = dedup.dedup_totals(df, dedup.normalize_key(F.col("email"))).first()
    assert (row["two_occurrences"], row["three_to_five"], row["more_than_five"]) == (1, 2, 1)
    assert (row["total_rows"], row["unique_rows"], row["duplicate_rows"], row["duplicate_keys"]) == (21, 9, 12, 4)


def test_report_lists_every_occurrence(spark):
    df, rows = uploaded(spark)
    key = dedup.normalize_key(F.col("email"))
    report = dedup.duplicate_report(df, key)
    hot = report.filter("first_row = 3").first()
    assert hot["occurrences"] == 200 and hot["last_row"] == 600
    listed = dedup.duplicate_occurrences(df, key, slice_rows=11).filter("first_row = 3").orderBy("occurrence").collect()
    assert [(r["row_number"], r["occurrence"]) for r in listed] == [(3 * k, k) for k in range(1, 201)]
    counts = {}
    for _, k, _ in rows:
        if normal(k) is not None:
            counts[normal(k)] = counts.get(normal(k), 0) + 1
    assert report.count() == sum(1 for c in counts.values() if c > 1)


def test_disabled_and_unknown_strategy(spark):
    df, _ = uploaded(spark, 20)
    assert dedup.mark_duplicates(df, F.col("email"), enabled=False).filter("action <> 'keep'").count() == 0
    with pytest.raises(ValueError):
        dedup.deduplicate(df, F.col("email"), "keep_some")


def test_survivors_fold_before_the_shuffle(spark):
    df, _ = uploaded(spark)
    keyed = dedup._with_group(df, dedup.normalize_key(F.col("email")), False)
    plan = dedup._losing_rows(keyed, "row_number", F.min)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert "partial_min(" in plan


def test_rows_only_lose_the_others_of_their_key(spark):
    """Few losers: the rows themselves are not moved."""
    df = spark.createDataFrame([(i, f"k{i % 90}", "x" * 50) for i in range(100)], "row_number long, email string, text string")
    kept = dedup.one_per_key(df, F.col("email"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r["row_number"] for r in kept.collect()) == list(range(90))
