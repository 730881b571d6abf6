"""Queries: request-rate limits. A third of the users share one busy account."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import REQUESTS_SQL, requests
from rowmill.catalog.registry import query
from rowmill.operators import limits

HOUR = 3_600_000

_SLIDING_SQL = f"""{REQUESTS_SQL}, d AS (SELECT DISTINCT account_id, ms FROM requests),
    c AS (SELECT account_id, ms, count(*) OVER (PARTITION BY account_id ORDER BY ms
      RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS in_window FROM d),
    limited AS (SELECT r.account_id, r.event_id, c.in_window, c.in_window <= 5 AS allowed FROM requests r
      JOIN c ON r.account_id = c.account_id AND r.ms = c.ms)"""


def _sliding(spark, folder):
    return limits.sliding_limit(requests(spark, folder), limit=5, window_ms=HOUR, slice_windows=4)


@query("rate_limit_sliding", f"WITH {_SLIDING_SQL} SELECT account_id, event_id, in_window, allowed FROM limited")
def rate_limit_sliding(spark, folder):
    return _sliding(spark, folder).select("account_id", "event_id", "in_window", "allowed")


@query(
    "rate_limit_summary",
    f"""WITH {_SLIDING_SQL} SELECT account_id, count(*) AS requests, count(*) FILTER (NOT allowed) AS rejected,
      max(in_window) AS peak_in_window FROM limited GROUP BY account_id""",
)
def rate_limit_summary(spark, folder):
    return limits.sliding_summary(_sliding(spark, folder))


_SESSION_SQL = f"""{REQUESTS_SQL}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= {HOUR} THEN 1 ELSE 0 END AS opens FROM requests
      WINDOW w AS (PARTITION BY account_id ORDER BY ms, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY account_id ORDER BY ms, event_id) AS session FROM g),
    limited AS (SELECT account_id, event_id, ms,
      row_number() OVER (PARTITION BY account_id, session ORDER BY ms, event_id) AS current FROM s)"""


def _session(spark, folder):
    return limits.session_limit(requests(spark, folder), limit=3, window_ms=HOUR, slice_ms=5 * HOUR)


@query(
    "rate_limit_session",
    f"""WITH {_SESSION_SQL} SELECT account_id, event_id, current, current <= 3 AS allowed,
      greatest(0, 3 - current) AS remaining, ms + {HOUR} AS reset_ms FROM limited""",
)
def rate_limit_session(spark, folder):
    return _session(spark, folder).select("account_id", "event_id", "current", "allowed", "remaining", "reset_ms")


@query(
    "rate_limit_sessions",
    f"""WITH {_SESSION_SQL} SELECT account_id, count(*) AS requests, count(*) FILTER (current = 1) AS sessions,
      max(current) AS longest, count(*) FILTER (current > 3) AS rejected FROM limited GROUP BY account_id""",
)
def rate_limit_sessions(spark, folder):
    return limits.session_summary(_session(spark, folder))


@query(
    "rate_limit_sliding_busy",
    """WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'busy' ELSE 'a' || (l_suppkey % 20) END AS account_id,
      l_orderkey * 40 + l_linenumber AS ms FROM lineitem),
    d AS (SELECT DISTINCT * FROM r),
    c AS (SELECT account_id, ms, count(*) OVER (PARTITION BY account_id ORDER BY ms
      RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS n FROM d)
    SELECT account_id, max(n) AS peak, count(*) AS entries, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY account_id""",
)
def rate_limit_sliding_busy(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.when(F.col("l_returnflag") == "R", "busy")
        .otherwise(F.concat(F.lit("a"), F.col("l_suppkey") % 20))
        .alias("account_id"),
        (F.col("l_orderkey") * 40 + F.col("l_linenumber")).alias("ms"),
    )
    counts = limits.sliding_counts(rows, slice_windows=2)
    return counts.groupBy("account_id").agg(
        F.max("in_window").alias("peak"),
        F.count(F.lit(1)).alias("entries"),
        F.sum("in_window").alias("total"),
    )
