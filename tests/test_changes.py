import random

from pyspark.sql import functions as F

from rowmill.operators import merge, stats
from rowmill.plans import bulk_update, reports
from rowmill.spec import ACTIONS

TARGET = "id string, name string, email string, age int, updated_at long"
UPDATE = "row_number long, id string, name string, email string, age int"


def now():
    return F.lit(99).cast("bigint")


def target(spark):
    return spark.createDataFrame([("1", "a", "a@x", 10, 0), ("2", "b", "b@x", 20, 0), ("3", "c", "c@x", 30, 0)], TARGET)


def test_update_by_id(spark):
    updates = spark.createDataFrame(
        [(1, "1", "A", "z@x", None), (2, "9", "Z", "q@x", 1), (3, "2", "B1", "b@x", 21), (4, "2", "B2", "b@x", 22), (5, None, "N", "n@x", 1)],
        UPDATE,
    )
    state = {r["id"]: tuple(r)[1:] for r in merge.bulk_update(target(spark), updates, now=now()).collect()}
    assert state == {"1": ("A", "a@x", None, 99), "2": ("B2", "b@x", 22, 99), "3": ("c", "c@x", 30, 0)}
    missing = merge.missing_updates(updates, target(spark)).collect()
    assert {r["row_number"] for r in missing} == {2, 5}
    by_email = merge.missing_updates(updates, target(spark), failed_by="email").collect()
    assert {r["row_number"] for r in by_email} == {1, 2, 5}


def test_update_outcomes_add_up(spark):
    updates = spark.createDataFrame(
        [(1, "1", "A", "z@x.io", None), (2, "9", "Z", "q@x.io", 1), (3, "2", "", "b@x.io", 200)], UPDATE
    )
    outcomes = merge.update_outcomes(updates, target(spark))
    found = {r["row_number"]: (r["outcome"], r["error"]) for r in outcomes.collect()}
    assert found[1] == ("updated", None)
    assert found[2] == ("failed", "Contact with id 9 not found for update")
    assert found[3][1] == (
        "Validation failed: name: Name cannot be empty, age: Number must be less than or equal to 150"
    )
    counts = merge.outcome_counts(outcomes).first()
    assert counts["processed"] == counts["successful"] + counts["failed"] + counts["skipped"] == 3


def upsert_by_loop(stored, rows, mode):
    state = {e: (n, a) for e, n, a in stored}
    outcomes = {}
    for number, email, name, age in rows:
        if email is not None and email in state:
            outcomes[number] = {"skip": "skipped", "update": "updated", "error": "error"}[mode]
            if mode == "update":
                state[email] = (name, age)
        else:
            outcomes[number] = "created"
            state[email if email is not None else ("row", number)] = (name, age)
    return outcomes, sorted(state.values(), key=repr)


def test_upsert_equals_a_loop(spark):
    rng = random.Random(5)
    stored = [(f"e{i}", f"s{i}", i) for i in range(10)]
    rows = [
        (i, "e3" if i % 3 == 0 else rng.choice([None, f"e{rng.randint(0, 30)}"]), f"n{i}", rng.choice([None, i]))
        for i in range(1, 200)
    ]
    old = spark.createDataFrame([(e, n, e, a, 0) for e, n, a in stored], TARGET)
    new = spark.createDataFrame(rows, "row_number long, email string, name string, age int")
    for mode in ("skip", "update", "error"):
        outcomes, state = upsert_by_loop(stored, rows, mode)
        found = {r["row_number"]: r["outcome"] for r in merge.upsert_outcomes(old, new, on_conflict=mode).collect()}
        assert found == outcomes
        result = merge.upsert(old, new, on_conflict=mode, now=now()).collect()
        assert sorted(((r["name"], r["age"]) for r in result), key=repr) == state
        assert len({r["id"] for r in result}) == len(result)


def test_patch_tells_absent_from_null(spark):
    patches = spark.createDataFrame(
        [(1, "1", "x", True, None, False), (2, "1", None, False, None, True), (3, "2", None, False, 7, True), (4, "9", "q", True, 1, True)],
        "row_number long, id string, name string, has_name boolean, age int, has_age boolean",
    )
    state = {r["id"]: (r["name"], r["age"], r["updated_at"]) for r in merge.patch(target(spark), patches, ["name", "age"], now=now()).collect()}
    assert state == {"1": ("x", None, 99), "2": ("b", 7, 99), "3": ("c", 30, 0)}
    assert [r["id"] for r in merge.not_found(patches, target(spark)).collect()] == ["9"]


def test_conflicts_deletes_and_orphans(spark):
    updates = spark.createDataFrame([(1, "1", "", "b@x", 1), (2, "2", "", "b@x", 1), (3, "3", "", "new@x", 1)], UPDATE)
    found = [(r["row_number"], r["owner_id"]) for r in merge.email_conflicts(updates, target(spark)).collect()]
    assert found == [(1, "2")]
    child = spark.createDataFrame([("1",), ("2",), ("7",)], "action_id string")
    keys = spark.createDataFrame([("2",), ("2",)], "id string")
    parents, children = merge.delete_cascade(target(spark), child, keys, "id", "action_id")
    assert parents.count() == 2 and {r[0] for r in children.collect()} == {"1", "7"}
    assert [r[0] for r in merge.orphans(child, target(spark), "action_id", "id").collect()] == ["7"]


def test_status_updates_touch_only_listed_actions(spark):
    actions = spark.createDataFrame([("1", "queued", 0), ("2", "queued", 0), ("3", "queued", 0)], "id string, status string, updated_at long")
    updates = spark.createDataFrame([(1, "1", "processing"), (2, "1", None), (3, "2", None)], "row_number long, id string, status string")
    found = {r["id"]: (r["status"], r["updated_at"]) for r in merge.apply_status_updates(actions, updates, now=now()).collect()}
    assert found == {"1": ("processing", 99), "2": ("queued", 99), "3": ("queued", 0)}


def test_small_change_set_is_broadcast_by_its_size(spark, folder):
    spark.range(200_000).select(
        F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit(1).alias("age"), F.lit(0).cast("bigint").alias("updated_at")
    ).write.parquet(f"{folder}/t")
    updates = spark.createDataFrame([(1, "1", "A", 5)], "row_number long, id string, name string, age int")
    out = merge.bulk_update(spark.read.parquet(f"{folder}/t"), updates, now=now())
    assert out.filter("updated_at = 99").count() == 1
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_increments(spark):
    base = spark.createDataFrame([("a", 10, 1, 0, 0), ("b", 10, 0, 0, 0)], "action_id string, total_records long, successful_records long, failed_records long, skipped_records long")
    log = spark.createDataFrame([("a", 2, 0, 0), ("a", 3, -4, 1), ("z", 1, 1, 1), ("b", 0, 0, 0)], "action_id string, successful long, failed long, skipped long")
    found = {r["action_id"]: tuple(r)[2:] for r in stats.apply_increments(base, log).collect()}
    assert found == {"a": (3, 0, 0), "b": (0, 0, 0)}
    assert [r["error"] for r in stats.increment_errors(log).collect()] == ["Failed increment cannot be negative"]


def test_spec_renames_and_action_listing(spark):
    df = spark.createDataFrame([("1", "acct", "queued")], "id string, accountId string, status string")
    renamed = ACTIONS.rename_columns(df)
    assert renamed.columns == ["id", "account_id", "status"]
    listed, meta = reports.list_actions(
        renamed.withColumn("created_at", F.lit(1)), filters={"accountId": "acct", "status": None}
    )
    assert listed.count() == 1 and meta.first()["total_pages"] == 1


def test_run_adds_up_and_counts_every_row(spark):
    rows = spark.createDataFrame(
        [(1, "1", "a@x.io", "A", "11"), (2, "1", "A@x.io ", "B", "12"), (3, "2", "b@x.io", "C", "13"), (4, "9", "c@x.io", "D", "14"), (5, "", "d@x.io", "E", "1"), (6, "3", "bad", "F", "2")],
        "row_number long, id string, email string, name string, age string",
    )
    run = bulk_update.run(rows, target(spark), now=now())
    row = bulk_update.statistics(run, "run").first()
    assert (row["total_records"], row["successful_records"], row["failed_records"], row["skipped_records"]) == (6, 2, 3, 1)
    state = {r["id"]: (r["name"], r["age"]) for r in run.new_state.collect()}
    assert state == {"1": ("A", 11), "2": ("C", 13), "3": ("c", 30)}
