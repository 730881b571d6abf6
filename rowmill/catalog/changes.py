"""Queries: keyed changes. The target is customer, the change set comes from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import (
    ACTIONS_SQL,
    CHANGES_SQL,
    LINE_NUMBER,
    STATS_SQL,
    STORED_SQL,
    actions,
    changes,
    stats,
    stored,
)
from rowmill.catalog.registry import query, read
from rowmill.operators import merge

NOW = 1_700_000_000

LAST_SQL = """last AS (SELECT id, arg_max(struct_pack(n := name, a := age), row_number) AS r FROM changes GROUP BY id)"""


@query(
    "bulk_update",
    f"""WITH {STORED_SQL}, {CHANGES_SQL}, {LAST_SQL}
    SELECT s.id, CASE WHEN l.id IS NULL THEN s.name ELSE l.r.n END AS name, s.email,
      CASE WHEN l.id IS NULL THEN s.age ELSE l.r.a END AS age, s.nation,
      CASE WHEN l.id IS NULL THEN s.updated_at ELSE CAST({NOW} AS BIGINT) END AS updated_at
    FROM stored s LEFT JOIN last l ON s.id = l.id""",
)
def bulk_update(spark, folder):
    return merge.bulk_update(
        stored(spark, folder), changes(spark, folder), now=F.lit(NOW).cast("bigint")
    )


@query(
    "bulk_update_failures",
    f"""WITH {STORED_SQL}, {CHANGES_SQL} SELECT row_number, id,
      'Contact with id ' || id || ' not found for update' AS error FROM changes WHERE id NOT IN (SELECT id FROM stored)""",
)
def bulk_update_failures(spark, folder):
    return merge.missing_updates(changes(spark, folder), stored(spark, folder)).select("row_number", "id", "error")



@query(
    "bulk_update_failures_by_email",
    f"""WITH {STORED_SQL}, {CHANGES_SQL}, c AS (SELECT *, 'user' || substr(name, 2) || '@example.com' AS email FROM changes),
    hit AS (SELECT email FROM stored WHERE id IN (SELECT id FROM c))
    SELECT row_number, 'Contact with email ' || email || ' not found for update' AS error FROM c
    WHERE email NOT IN (SELECT email FROM hit)""",
)
def bulk_update_failures_by_email(spark, folder):
    rows = changes(spark, folder).withColumn(
        "email", F.concat(F.lit("user"), F.expr("substr(name, 2)"), F.lit("@example.com"))
    )
    return merge.missing_updates(rows, stored(spark, folder), failed_by="email").select("row_number", "error")


_OUTCOME_SQL = f"""{STORED_SQL}, {CHANGES_SQL}, o AS (SELECT c.row_number, c.id,
      CASE WHEN c.age < 1 THEN 'Validation failed: age: Number must be greater than or equal to 1'
        WHEN s.id IS NULL THEN 'Contact with id ' || c.id || ' not found for update' END AS error
      FROM (SELECT row_number, id, age - 2 AS age FROM changes) c LEFT JOIN stored s ON c.id = s.id)"""


def _outcomes(spark, folder):
    rows = changes(spark, folder).withColumns({"age": F.col("age") - 2, "email": F.lit("a@b.io")})
    return merge.update_outcomes(rows, stored(spark, folder))


@query(
    "update_outcomes",
    f"""WITH {_OUTCOME_SQL} SELECT row_number, id, CASE WHEN error IS NULL THEN 'updated' ELSE 'failed' END AS outcome,
      error FROM o""",
)
def update_outcomes(spark, folder):
    return _outcomes(spark, folder)


@query(
    "update_outcome_counts",
    f"""WITH {_OUTCOME_SQL} SELECT count(*) AS processed, count(*) FILTER (error IS NULL) AS successful,
      count(*) FILTER (error IS NOT NULL) AS failed, CAST(0 AS BIGINT) AS skipped FROM o""",
)
def update_outcome_counts(spark, folder):
    return merge.outcome_counts(_outcomes(spark, folder))


# Upsert: keys repeat inside the batch and partly exist in the target.
_INCOMING_SQL = f"""{STORED_SQL}, {CHANGES_SQL}, incoming AS (SELECT row_number, name, age,
      CASE WHEN name = 'n5' THEN NULL ELSE 'user' || substr(id, 3) || '@example.com' END AS email FROM changes),
    r AS (SELECT i.*, row_number() OVER (PARTITION BY i.email ORDER BY i.row_number) AS n, s.email IS NOT NULL AS known
      FROM incoming i LEFT JOIN stored s ON i.email = s.email)"""


def _incoming(spark, folder):
    email = F.concat(F.lit("user"), F.expr("substr(id, 3)"), F.lit("@example.com"))
    return changes(spark, folder).select(
        "row_number", "name", "age", F.when(F.col("name") != "n5", email).alias("email")
    )


def _verdict_sql(conflict: str) -> str:
    return f"""WITH {_INCOMING_SQL} SELECT row_number, CASE WHEN email IS NULL OR (n = 1 AND NOT known) THEN 'created'
      ELSE '{conflict}' END AS outcome FROM r"""


@query("upsert_skip", _verdict_sql("skipped"))
def upsert_skip(spark, folder):
    return merge.upsert_outcomes(stored(spark, folder), _incoming(spark, folder)).select("row_number", "outcome")


@query("upsert_update", _verdict_sql("updated"))
def upsert_update(spark, folder):
    rows = merge.upsert_outcomes(stored(spark, folder), _incoming(spark, folder), on_conflict="update")
    return rows.select("row_number", "outcome")


@query("upsert_error", _verdict_sql("error"))
def upsert_error(spark, folder):
    rows = merge.upsert_outcomes(stored(spark, folder), _incoming(spark, folder), on_conflict="error")
    return rows.select("row_number", "outcome")


_UUID = """substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' ||
    substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"""


def _state_sql(updating: bool) -> str:
    pick = "arg_max" if updating else "arg_min"
    take = "p.email IS NOT NULL" if updating else "s.id IS NULL"
    return f"""WITH {_INCOMING_SQL}, p AS (SELECT email, {pick}(struct_pack(n := name, a := age), row_number) AS r
      FROM incoming WHERE email IS NOT NULL GROUP BY email)
    SELECT coalesce(s.id, {_UUID.format("p.email")}) AS id, coalesce(s.email, p.email) AS email,
      CASE WHEN {take} THEN p.r.n ELSE s.name END AS name, CASE WHEN {take} THEN p.r.a ELSE s.age END AS age, s.nation,
      CASE WHEN {take} THEN CAST({NOW} AS BIGINT) ELSE s.updated_at END AS updated_at
    FROM stored s FULL JOIN p ON s.email = p.email
    UNION ALL SELECT {_UUID.format("'row-' || row_number")}, NULL, name, age, NULL, CAST({NOW} AS BIGINT)
    FROM incoming WHERE email IS NULL"""


@query("upsert_state_skip", _state_sql(False))
def upsert_state_skip(spark, folder):
    return merge.upsert(stored(spark, folder), _incoming(spark, folder), now=F.lit(NOW).cast("bigint"))


@query("upsert_state_update", _state_sql(True))
def upsert_state_update(spark, folder):
    return merge.upsert(
        stored(spark, folder), _incoming(spark, folder), on_conflict="update", now=F.lit(NOW).cast("bigint")
    )


@query(
    "upsert_stats",
    f"""WITH {STATS_SQL}, old AS (SELECT * FROM stats WHERE successful_records > 0),
    new AS (SELECT 'a-' || o_orderkey AS action_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS total_records FROM orders)
    SELECT coalesce(n.action_id, o.action_id) AS action_id, CAST(coalesce(n.total_records, o.total_records) AS BIGINT) AS total_records,
      CASE WHEN n.action_id IS NULL THEN o.successful_records ELSE 0 END AS successful_records,
      CASE WHEN n.action_id IS NULL THEN o.failed_records ELSE 0 END AS failed_records,
      CASE WHEN n.action_id IS NULL THEN o.skipped_records ELSE 0 END AS skipped_records
    FROM old o FULL JOIN new n ON o.action_id = n.action_id""",
)
def upsert_stats(spark, folder):
    old = stats(spark, folder).filter("successful_records > 0")
    new = read(spark, folder, "orders").select(
        F.concat(F.lit("a-"), F.col("o_orderkey")).alias("action_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("total_records"),
        F.col("o_orderkey").alias("row_number"),
    )
    return merge.upsert_stats(old, new)


@query(
    "patch_update",
    f"""WITH {STORED_SQL}, {CHANGES_SQL}, f AS (SELECT id,
      arg_max(struct_pack(v := name), row_number) FILTER (row_number % 3 <> 0) AS n,
      arg_max(struct_pack(v := age), row_number) FILTER (row_number % 2 = 0) AS a FROM changes GROUP BY id)
    SELECT s.id, CASE WHEN f.n IS NOT NULL THEN f.n.v ELSE s.name END AS name, s.email,
      CASE WHEN f.a IS NOT NULL THEN f.a.v ELSE s.age END AS age, s.nation,
      CASE WHEN f.id IS NULL THEN s.updated_at ELSE CAST({NOW} AS BIGINT) END AS updated_at
    FROM stored s LEFT JOIN f ON s.id = f.id""",
)
def patch_update(spark, folder):
    patches = changes(spark, folder).withColumns(
        {"has_name": F.col("row_number") % 3 != 0, "has_age": F.col("row_number") % 2 == 0}
    )
    return merge.patch(stored(spark, folder), patches, ["name", "age"], now=F.lit(NOW).cast("bigint"))


@query(
    "patch_not_found",
    f"""WITH {STORED_SQL}, {CHANGES_SQL} SELECT DISTINCT id FROM changes WHERE id NOT IN (SELECT id FROM stored)""",
)
def patch_not_found(spark, folder):
    return merge.not_found(changes(spark, folder), stored(spark, folder))


@query(
    "bulk_lookup",
    f"""WITH {STORED_SQL} SELECT id, email FROM stored WHERE email IN
      (SELECT lower('USER' || (item_id * 13) || '@EXAMPLE.COM') FROM benchmark)""",
)
def bulk_lookup(spark, folder):
    keys = read(spark, folder, "benchmark").select(
        F.concat(F.lit("USER"), F.col("item_id") * 13, F.lit("@EXAMPLE.COM")).alias("email")
    )
    return merge.lookup(stored(spark, folder), keys).select("id", "email")


@query(
    "key_exists",
    f"""WITH {STATS_SQL} SELECT DISTINCT 'a-' || o_orderkey AS action_id,
      'a-' || o_orderkey IN (SELECT action_id FROM stats) AS found FROM orders""",
)
def key_exists(spark, folder):
    keys = read(spark, folder, "orders").select(F.concat(F.lit("a-"), F.col("o_orderkey")).alias("action_id"))
    return merge.exists(stats(spark, folder), keys, "action_id")


_GONE = "SELECT 'a-' || l_orderkey FROM lineitem WHERE l_quantity >= 49"


def _cascade(spark, folder):
    keys = read(spark, folder, "lineitem").filter("l_quantity >= 49").select(
        F.concat(F.lit("a-"), F.col("l_orderkey")).alias("id")
    )
    return merge.delete_cascade(actions(spark, folder), stats(spark, folder), keys, "id", "action_id")


@query(
    "delete_cascade_parent",
    f"WITH {ACTIONS_SQL} SELECT id, status FROM actions WHERE id NOT IN ({_GONE})",
)
def delete_cascade_parent(spark, folder):
    return _cascade(spark, folder)[0].select("id", "status")


@query("delete_cascade_child", f"WITH {STATS_SQL} SELECT * FROM stats WHERE action_id NOT IN ({_GONE})")
def delete_cascade_child(spark, folder):
    return _cascade(spark, folder)[1]


@query("orphans", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "source")
    return merge.orphans(docs, read(spark, folder, "labels"), "doc_id", "doc_id")


@query(
    "repeated_keys",
    "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def repeated_keys(spark, folder):
    return merge.repeated_keys(read(spark, folder, "lineitem"), "l_orderkey")


@query(
    "email_conflicts",
    f"""WITH {STORED_SQL}, {CHANGES_SQL}, t AS (SELECT id, 'g' || nation || '@x.io' AS email FROM stored),
    o AS (SELECT email, min(id) AS lo, max(id) AS hi FROM t GROUP BY email),
    u AS (SELECT row_number, id, 'g' || (row_number % 40) || '@x.io' AS email FROM changes)
    SELECT u.row_number, u.id, u.email, CASE WHEN lo <> u.id THEN lo ELSE hi END AS owner_id FROM u JOIN o ON u.email = o.email
    WHERE lo <> u.id OR hi <> u.id""",
)
def email_conflicts(spark, folder):
    target = stored(spark, folder).select("id", F.concat(F.lit("g"), "nation", F.lit("@x.io")).alias("email"))
    updates = changes(spark, folder).select(
        "row_number", "id", F.concat(F.lit("g"), F.col("row_number") % 40, F.lit("@x.io")).alias("email")
    )
    return merge.email_conflicts(updates, target)


@query(
    "status_updates",
    f"""WITH {ACTIONS_SQL}, u AS (SELECT 'a-' || l_orderkey AS id, {LINE_NUMBER} AS o, l_returnflag AS f FROM lineitem),
    l AS (SELECT id, arg_max(CASE f WHEN 'R' THEN 'failed' ELSE 'completed' END, o) FILTER (f <> 'N') AS status FROM u GROUP BY id)
    SELECT a.id, coalesce(l.status, a.status) AS status, l.id IS NOT NULL AS touched FROM actions a LEFT JOIN l ON a.id = l.id""",
)
def status_updates(spark, folder):
    updates = read(spark, folder, "lineitem").select(
        F.concat(F.lit("a-"), F.col("l_orderkey")).alias("id"),
        F.expr(LINE_NUMBER).alias("row_number"),
        F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "completed").alias("status"),
    )
    table = actions(spark, folder).withColumn("updated_at", F.lit(0).cast("bigint"))
    changed = merge.apply_status_updates(table, updates, now=F.lit(NOW).cast("bigint"))
    return changed.select("id", "status", (F.col("updated_at") == NOW).alias("touched"))


@query(
    "action_details",
    f"""WITH {ACTIONS_SQL}, {STATS_SQL} SELECT a.id, a.status, s.total_records, s.successful_records FROM actions a
      LEFT JOIN stats s ON a.id = s.action_id""",
)
def action_details(spark, folder):
    rows = merge.actions_with_stats(actions(spark, folder), stats(spark, folder))
    return rows.select("id", "status", "total_records", "successful_records")


@query(
    "failure_union",
    f"""WITH {_OUTCOME_SQL}, m AS (SELECT row_number, error FROM o WHERE error LIKE 'Contact%'),
    v AS (SELECT row_number, error FROM o WHERE error LIKE 'Validation%') SELECT * FROM m UNION ALL SELECT * FROM v""",
)
def failure_union(spark, folder):
    rows = _outcomes(spark, folder).filter("outcome = 'failed'").select("row_number", "error")
    missing = rows.filter(F.col("error").startswith("Contact"))
    broken = rows.filter(F.col("error").startswith("Validation"))
    return merge.union_failures(missing, broken)


@query("distinct_actions", f"WITH {CHANGES_SQL} SELECT DISTINCT id FROM changes")
def distinct_actions(spark, folder):
    return changes(spark, folder).select("id").distinct()
