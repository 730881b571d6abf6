"""Queries: filtered, sorted and paged lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import ACTIONS_SQL, STATS_SQL, STORED_SQL, actions, stats, stored
from rowmill.catalog.registry import query
from rowmill.operators import paging
from rowmill.plans import reports

_RANK = "CASE status WHEN 'processing' THEN 1 WHEN 'queued' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END"


@query(
    "newest_page",
    f"WITH {ACTIONS_SQL} SELECT id, status FROM actions ORDER BY created_at DESC, id LIMIT 20 OFFSET 40",
)
def newest_page(spark, folder):
    return paging.page(actions(spark, folder), paging.newest_first(), 3, 20).select("id", "status")


@query(
    "list_actions_page",
    f"""WITH {ACTIONS_SQL} SELECT id, status, entity_type FROM actions WHERE entity_type = 'contact'
    ORDER BY {_RANK}, created_at DESC, id LIMIT 50 OFFSET 50""",
)
def list_actions_page(spark, folder):
    rows, _ = reports.list_actions(actions(spark, folder), 2, 50, {"entityType": "contact", "unknown": 1, "status": None})
    return rows.select("id", "status", "entity_type")


@query(
    "list_actions_meta",
    f"""WITH {ACTIONS_SQL}, t AS (SELECT count(*) AS total FROM actions WHERE status = 'failed'
      AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1997-01-01')
    SELECT 2 AS page, 25 AS limit, total, CAST(ceil(total / 25.0) AS BIGINT) AS total_pages,
      2 < ceil(total / 25.0) AS has_next, true AS has_prev FROM t""",
)
def list_actions_meta(spark, folder):
    from datetime import datetime

    _, meta = reports.list_actions(
        actions(spark, folder), 2, 25, {"status": "failed"}, datetime(1996, 1, 1), datetime(1997, 1, 1)
    )
    return meta


@query(
    "page_after",
    f"""WITH {ACTIONS_SQL} SELECT id FROM actions WHERE created_at < TIMESTAMP '1997-03-03'
      OR (created_at = TIMESTAMP '1997-03-03' AND id > 'a-500') ORDER BY created_at DESC, id LIMIT 30""",
)
def page_after(spark, folder):
    from datetime import datetime

    return paging.page_after(actions(spark, folder), datetime(1997, 3, 3), "a-500", 30).select("id")


@query(
    "search_contacts",
    f"""WITH {STORED_SQL} SELECT id, name, email FROM stored WHERE (name ILIKE '%omer#0000001%' OR email ILIKE '%omer#0000001%')
      AND nation = 19""",
)
def search_contacts(spark, folder):
    rows = paging.search_contacts(stored(spark, folder), search="OMER#0000001", nation=19)
    return rows.select("id", "name", "email")


@query(
    "search_contacts_page",
    f"""WITH {STORED_SQL} SELECT id, name, nation FROM stored WHERE name ILIKE '%omer#00000%' OR email ILIKE '%omer#00000%'
      ORDER BY nation DESC, id LIMIT 10 OFFSET 10""",
)
def search_contacts_page(spark, folder):
    """Search, newest first, second page; the nation stands for the time of creation."""
    found = paging.search_contacts(stored(spark, folder), search="OMER#00000")
    return paging.page(found, paging.newest_first("id", "nation"), number=2).select("id", "name", "nation")


@query("search_email", f"WITH {STORED_SQL} SELECT id, name FROM stored WHERE email = 'user77@example.com'")
def search_email(spark, folder):
    return paging.search_contacts(stored(spark, folder), email="User77@Example.COM").select("id", "name")


@query("filter_actions", f"WITH {ACTIONS_SQL} SELECT id FROM actions WHERE status = 'queued' AND account_id = 'acct-8'")
def filter_actions(spark, folder):
    rows = paging.where_equal(actions(spark, folder), {"status": "queued", "account_id": "acct-8"})
    return rows.select("id")


@query(
    "one_action_statistics",
    f"WITH {STATS_SQL} SELECT action_id, total_records FROM stats WHERE action_id = 'a-100'",
)
def one_action_statistics(spark, folder):
    return reports.action_statistics(stats(spark, folder), "a-100").select("action_id", "total_records")


@query(
    "one_action_details",
    f"""WITH {ACTIONS_SQL}, {STATS_SQL} SELECT a.id, a.status, s.total_records FROM actions a
    LEFT JOIN stats s ON a.id = s.action_id WHERE a.id = 'a-100'""",
)
def one_action_details(spark, folder):
    rows = reports.action_details(actions(spark, folder), stats(spark, folder), "a-100")
    return rows.select("id", "status", "total_records")


@query("stored_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def stored_scan(spark, folder):
    rows = paging.where_equal(
        spark.read.parquet(f"{folder}/orders.parquet"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    )
    return rows.select("o_orderkey", F.col("o_totalprice"))
