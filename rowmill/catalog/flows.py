"""Queries: the whole bulk update."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import contacts, stored
from rowmill.catalog.registry import query, read
from rowmill.catalog.validation import CHECKED_SQL
from rowmill.operators import merge, stats
from rowmill.plans import bulk_update

NOW = 1_700_000_000

_SPACE = 2**64 - 1
FLOW_SQL = f"""{CHECKED_SQL},
    marked AS (SELECT row_number, id, email, name, CAST(age AS INTEGER) AS age, segment, len(errors) = 0 AS ok,
      row_number() OVER (PARTITION BY email, len(errors) = 0 ORDER BY row_number) AS n FROM checked),
    kept AS (SELECT * FROM marked WHERE ok AND n = 1),
    size AS (SELECT greatest(1, CAST(ceil(count(*) / 1000.0) AS BIGINT)) AS chunks FROM marked WHERE ok),
    routed AS (SELECT m.*, CASE WHEN ok AND n = 1 THEN CAST(least(CAST(CAST(('0x' || substr(sha256(lower(id)), 1, 16)) AS UBIGINT)
      AS HUGEINT) // (CAST({_SPACE} AS HUGEINT) // chunks), chunks - 1) AS INTEGER) END AS chunk_index FROM marked m, size),
    target AS (SELECT * FROM (SELECT 'c-' || c_custkey AS id, c_name AS name, CAST(18 + c_custkey % 60 AS INTEGER) AS age,
      CAST(0 AS BIGINT) AS updated_at FROM customer) WHERE id IN (SELECT 'c-' || o_custkey FROM orders WHERE o_orderstatus = 'F'))"""


def _target(spark, folder):
    """Customers with a finished order; the others are unknown to the table."""
    known = read(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        F.concat(F.lit("c-"), "o_custkey").alias("id")
    )
    return merge.lookup(stored(spark, folder).select("id", "name", "age", "updated_at"), known, "id", False)


def _run(spark, folder):
    return bulk_update.run(
        contacts(spark, folder), _target(spark, folder), now=F.lit(NOW).cast("bigint")
    )


@query(
    "flow_annotated",
    f"""WITH {FLOW_SQL} SELECT row_number, ok AS is_valid, CASE WHEN NOT ok THEN NULL WHEN n = 1 THEN 'keep' ELSE 'skip' END AS action,
      chunk_index FROM routed""",
)
def flow_annotated(spark, folder):
    return _run(spark, folder).annotated.select("row_number", "is_valid", "action", "chunk_index")


@query(
    "flow_statistics",
    f"""WITH {FLOW_SQL}, h AS (SELECT k.id IN (SELECT id FROM target) AS hit FROM kept k)
    SELECT 'run-1' AS action_id, (SELECT count(*) FROM marked) AS total_records,
      (SELECT count(*) FILTER (hit) FROM h) AS successful_records,
      (SELECT count(*) FILTER (NOT ok) FROM marked) + (SELECT count(*) FILTER (NOT hit) FROM h) AS failed_records,
      (SELECT count(*) FILTER (ok AND n > 1) FROM marked) AS skipped_records""",
)
def flow_statistics(spark, folder):
    return bulk_update.statistics(_run(spark, folder), "run-1")


@query(
    "flow_new_state",
    f"""WITH {FLOW_SQL} SELECT t.id, coalesce(k.name, t.name) AS name, coalesce(k.age, t.age) AS age,
      CASE WHEN k.id IS NULL THEN t.updated_at ELSE CAST({NOW} AS BIGINT) END AS updated_at FROM target t LEFT JOIN kept k ON t.id = k.id""",
)
def flow_new_state(spark, folder):
    return _run(spark, folder).new_state


@query(
    "flow_outcomes",
    f"""WITH {FLOW_SQL} SELECT row_number, id, CASE WHEN id IN (SELECT id FROM target) THEN 'updated' ELSE 'failed' END AS outcome
    FROM kept""",
)
def flow_outcomes(spark, folder):
    return _run(spark, folder).outcomes.select("row_number", "id", "outcome")


@query(
    "run_result",
    f"""WITH {FLOW_SQL} SELECT segment, count(*) AS total_records, count(*) FILTER (ok) AS valid_records,
      count(*) FILTER (NOT ok) AS invalid_records, count(*) FILTER (ok AND n > 1) AS skipped_records,
      count(DISTINCT chunk_index) AS chunks_created FROM routed GROUP BY segment""",
)
def run_result(spark, folder):
    routed = _run(spark, folder).annotated
    return stats.run_result(routed, ["segment"])
