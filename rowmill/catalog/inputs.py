"""Inputs of the queries, derived from the given tables.

The derivations are plain expressions that mean the same in Spark and in the
checking SQL, so both sides start from the same rows; what is under test is
written twice. They put dirty cells into some rows and give one key or account
about a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.catalog.registry import read
from rowmill.functions.numbers import epoch_ms

# customer as an uploaded contacts file; all cells are text, row numbers start at 1
CONTACT_CELLS = {
    "row_number": "c_custkey + 1",
    "id": "CASE WHEN c_custkey % 50 = 17 THEN '' ELSE 'c-' || CAST(c_custkey AS STRING) END",
    "email": """CASE WHEN c_custkey % 23 = 5 THEN 'bad.address' WHEN c_custkey % 29 = 3 THEN ''
        WHEN c_custkey % 31 = 4 THEN '@x.io' WHEN c_custkey % 37 = 6 THEN 'a@b'
        WHEN c_custkey % 41 = 7 THEN 'dots..in@example.com' WHEN c_nationkey < 8 THEN ' Shared@Example.com'
        ELSE '  User' || CAST(c_custkey - c_custkey % 3 AS STRING) || '@Example.COM ' END""",
    "name": """CASE WHEN c_custkey % 43 = 2 THEN '=HYPERLINK(1)' WHEN c_custkey % 47 = 9 THEN 'a <ScRiPt>'
        WHEN c_custkey % 53 = 11 THEN repeat('n', 300) WHEN c_custkey % 59 = 13 THEN ''
        WHEN c_custkey % 61 = 14 THEN c_name || chr(7) || 'x'
        ELSE chr(160) || c_name || chr(9) END""",
    "age": """CASE c_custkey % 67 WHEN 0 THEN '12abc' WHEN 1 THEN '0' WHEN 2 THEN '151' WHEN 3 THEN '-5'
        WHEN 4 THEN '+5' WHEN 5 THEN '' WHEN 6 THEN ' 42 ' WHEN 7 THEN 'old'
        ELSE CAST(18 + c_custkey % 60 AS STRING) END""",
    "segment": """CASE WHEN c_custkey % 71 = 1 THEN 'JavaScript:alert(1)' WHEN c_custkey % 73 = 1
        THEN 'data:text/html;base64,xx' WHEN c_custkey % 79 = 1 THEN '@' || c_mktsegment ELSE c_mktsegment END""",
}

# customer as the stored contacts table
STORED_CELLS = {
    "id": "'c-' || CAST(c_custkey AS STRING)",
    "name": "c_name",
    "email": "'user' || CAST(c_custkey AS STRING) || '@example.com'",
    "age": "CAST(18 + c_custkey % 60 AS INT)",
    "nation": "c_nationkey",
    "updated_at": "CAST(0 AS BIGINT)",
}

# Unique number of a lineitem row, made of its order, price and line.
LINE_NUMBER = "l_orderkey * 1000000000 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 10 + l_linenumber"

# lineitem as a change set for customer: repeated and unknown ids, null ages, a third on one id
CHANGE_CELLS = {
    "row_number": LINE_NUMBER,
    "id": """'c-' || CAST(CASE WHEN l_returnflag = 'R' THEN 7 ELSE (l_orderkey * 7 + l_linenumber) % 200000 END AS STRING)""",
    "name": "'n' || CAST(l_partkey AS STRING)",
    "age": "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS INT) END",
}

# orders as actions; the status follows the priority
ACTION_CELLS = {
    "id": "'a-' || CAST(o_orderkey AS STRING)",
    "account_id": """CASE WHEN o_custkey % 97 = 0 THEN '' WHEN o_custkey % 89 = 0 THEN 'bad id!'
        ELSE 'acct-' || CAST(o_custkey AS STRING) END""",
    "entity_type": "CASE WHEN o_orderkey % 83 = 1 THEN 'company' ELSE 'contact' END",
    "action_type": "CASE WHEN o_orderkey % 79 = 1 THEN 'bulk_delete' ELSE 'bulk_update' END",
    "status": """CASE o_orderpriority WHEN '1-URGENT' THEN 'processing' WHEN '2-HIGH' THEN 'queued'
        WHEN '3-MEDIUM' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN 'completed'
        ELSE CASE o_orderstatus WHEN 'F' THEN 'cancelled' WHEN 'O' THEN 'scheduled' ELSE 'validating' END END""",
    "total_entities": "CAST(floor(o_totalprice) AS BIGINT) % 5000 - 10",
    "configuration": """CASE WHEN o_orderkey % 5 = 0 THEN '{"deduplicate": true, "onConflict": "update"}'
        WHEN o_orderkey % 5 = 1 THEN '{"deduplication": true}' WHEN o_orderkey % 5 = 2 THEN '{"onConflict": "merge"}'
        WHEN o_orderkey % 5 = 3 THEN 'not json' ELSE '{"deduplicate": false, "filePath": "raw.csv"}' END""",
    "created_at": "o_orderdate",
    "scheduled_at": "CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 2 HOUR END",
}

# lineitem folded to counters per order; some totals are off by one
STATS_CELLS = {
    "action_id": "'a-' || CAST(l_orderkey AS STRING)",
    "total_records": "CAST(count(*) + (l_orderkey % 4) - 1 AS BIGINT)",
    "successful_records": "CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT)",
    "failed_records": "CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT)",
    "skipped_records": "CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT)",
}

# lineitem as increments of those counters
INCREMENT_CELLS = {
    "action_id": "'a-' || CAST(l_orderkey AS STRING)",
    "successful": "CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END",
    "failed": "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) - 5 ELSE 0 END",
    "skipped": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END",
}

# events as requests; a third of the users are one busy account
REQUEST_CELLS = {
    "account_id": "CASE WHEN user_id % 3 = 0 THEN 'busy' ELSE 'u-' || CAST(user_id AS STRING) END",
    "event_id": "event_id",
    "ts": "ts",
    "event_type": "event_type",
}

# events as log of status changes
CHANGE_LOG_CELLS = {
    "action_id": "CASE WHEN user_id % 3 = 0 THEN 'a-busy' ELSE 'a-' || CAST(user_id AS STRING) END",
    "event_id": "event_id",
    "ts": "ts",
    "status": """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'validating' WHEN 'click' THEN 'processing'
        WHEN 'purchase' THEN 'completed' ELSE 'failed' END""",
}


def as_list(cells: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in cells.items()]


def as_cte(name: str, cells: dict[str, str], table: str, tail: str = "") -> str:
    return f"{name} AS (SELECT {', '.join(as_list(cells))} FROM {table} {tail})"


CONTACTS_SQL = as_cte("contacts", CONTACT_CELLS, "customer")
STORED_SQL = as_cte("stored", STORED_CELLS, "customer")
CHANGES_SQL = as_cte("changes", CHANGE_CELLS, "lineitem")
ACTIONS_SQL = as_cte("actions", ACTION_CELLS, "orders")
STATS_SQL = as_cte("stats", STATS_CELLS, "lineitem", "GROUP BY l_orderkey")
INCREMENTS_SQL = as_cte("increments", INCREMENT_CELLS, "lineitem")
REQUESTS_SQL = as_cte("requests0", REQUEST_CELLS, "events") + (
    ", requests AS (SELECT *, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM requests0)"
)
CHANGE_LOG_SQL = as_cte("log0", CHANGE_LOG_CELLS, "events") + (
    ", log AS (SELECT *, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM log0)"
)


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").selectExpr(*as_list(CONTACT_CELLS))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").selectExpr(*as_list(STORED_CELLS))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr(*as_list(CHANGE_CELLS))


def actions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*as_list(ACTION_CELLS))


def stats(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    return spark.sql(
        f"SELECT {', '.join(as_list(STATS_CELLS))} FROM {{lines}} GROUP BY l_orderkey", lines=lines
    )


def increments(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr(*as_list(INCREMENT_CELLS))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "events").selectExpr(*as_list(REQUEST_CELLS)).withColumn("ms", epoch_ms(F.col("ts")))
    )


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "events")
        .selectExpr(*as_list(CHANGE_LOG_CELLS))
        .withColumn("ms", epoch_ms(F.col("ts")))
    )
