"""Queries: duplicate handling.

Documents are compared by their whole normalised text, contacts by email; a
third of the contacts share one email.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import CONTACTS_SQL, contacts
from rowmill.catalog.registry import query, read
from rowmill.functions.ordered import row_slice
from rowmill.operators import dedup

_S = r"[\s\x0B\p{Z}\x{FEFF}]"


def _key_sql(c: str) -> str:
    """Stripped, lower-cased, single blanks; null for null and empty."""
    collapsed = f"regexp_replace({c}, '{_S}+', ' ', 'g')"
    return f"CASE WHEN {c} <> '' THEN lower(trim({collapsed}, ' ')) END"


DOCS_SQL = f"docs AS (SELECT doc_id AS row_number, text, lang, source, {_key_sql('text')} AS k FROM documents)"
KEYED_SQL = f"{CONTACTS_SQL}, keyed AS (SELECT *, {_key_sql('email')} AS k FROM contacts)"

RANKED_SQL = """ranked AS (SELECT *,
    CASE WHEN k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k ORDER BY row_number) END AS n,
    CASE WHEN k IS NOT NULL THEN min(row_number) OVER (PARTITION BY k) END AS lo,
    CASE WHEN k IS NOT NULL THEN max(row_number) OVER (PARTITION BY k) END AS hi FROM {0})"""


def documents(spark, folder):
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("row_number"), "text", "lang", "source"
    )


def _text_key():
    return dedup.normalize_key(F.col("text"))


def _email_key():
    return dedup.normalize_key(F.col("email"))


@query(
    "dedup_keep_first",
    f"""WITH {DOCS_SQL}, {RANKED_SQL.format('docs')} SELECT row_number, text, lang, source FROM ranked WHERE n = 1""",
)
def dedup_keep_first(spark, folder):
    return dedup.deduplicate(documents(spark, folder), _text_key(), "keep_first", long_keys=True)


@query(
    "dedup_keep_last",
    f"""WITH {DOCS_SQL}, {RANKED_SQL.format('docs')} SELECT row_number, text, lang, source FROM ranked
    WHERE k IS NULL OR row_number = hi""",
)
def dedup_keep_last(spark, folder):
    return dedup.deduplicate(documents(spark, folder), _text_key(), "keep_last", long_keys=True)


def _marked(spark, folder, strategy):
    # Narrow slices, so that frequent keys span several even on small tables.
    rows = contacts(spark, folder).select("row_number", "email")
    marked = dedup.mark_duplicates(rows, _email_key(), strategy, slice_rows=256)
    return marked.select("row_number", "duplicate_count", "first_occurrence", "action")


def _marked_sql(action: str) -> str:
    return f"""WITH {KEYED_SQL}, {RANKED_SQL.format('keyed')}
    SELECT row_number, CAST(n AS BIGINT) AS duplicate_count, lo AS first_occurrence, {action} AS action FROM ranked"""


@query("dedup_verdicts", _marked_sql("CASE WHEN n = 1 THEN 'keep' ELSE 'skip' END"))
def dedup_verdicts(spark, folder):
    return _marked(spark, folder, "keep_first")


@query("dedup_verdicts_last", _marked_sql("CASE WHEN k IS NULL OR row_number = hi THEN 'keep' ELSE 'skip' END"))
def dedup_verdicts_last(spark, folder):
    return _marked(spark, folder, "keep_last")


@query("dedup_mark", _marked_sql("CASE WHEN n = 1 THEN 'keep' ELSE 'review' END"))
def dedup_mark(spark, folder):
    return _marked(spark, folder, "mark_all")


@query(
    "dedup_merge",
    """WITH base AS (SELECT c_custkey + 1 AS row_number,
      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name,
      CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS segment,
      CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_nationkey < 8 THEN 'N' ELSE ' n' || (c_custkey % 40) END AS k0 FROM customer),
    g AS (SELECT *, CASE WHEN k0 = '' THEN 'row ' || row_number ELSE lower(trim(k0)) END AS g FROM base)
    SELECT min(row_number) AS row_number, arg_min(name, row_number) FILTER (name <> '') AS name,
      arg_min(segment, row_number) FILTER (segment <> '') AS segment, count(*) AS merged_rows FROM g GROUP BY g""",
)
def dedup_merge(spark, folder):
    key = F.col("c_custkey")
    rows = read(spark, folder, "customer").select(
        (key + 1).alias("row_number"),
        F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("segment"),
        F.when(key % 19 == 0, "")
        .when(F.col("c_nationkey") < 8, "N")
        .otherwise(F.concat(F.lit(" n"), key % 40))
        .alias("k0"),
    )
    merged = dedup.merge_per_key(rows, dedup.normalize_key(F.col("k0")))
    return merged.select("row_number", "name", "segment", "merged_rows")


@query(
    "dedup_disabled",
    f"""WITH {CONTACTS_SQL} SELECT row_number, CAST(1 AS BIGINT) AS duplicate_count, 'keep' AS action FROM contacts""",
)
def dedup_disabled(spark, folder):
    rows = contacts(spark, folder).select("row_number", "email")
    marked = dedup.mark_duplicates(rows, _email_key(), enabled=False)
    return marked.select("row_number", "duplicate_count", "action")


@query(
    "normalize_keys",
    f"""SELECT doc_id, sha256({_key_sql('text')}) AS all_switches,
      sha256(regexp_replace(regexp_replace(text, '^{_S}+', ''), '{_S}+$', '')) AS trim_only,
      sha256(lower(text)) AS case_only FROM documents""",
)
def normalize_keys(spark, folder):
    c = F.col("text")
    return read(spark, folder, "documents").select(
        "doc_id",
        F.sha2(dedup.normalize_key(c), 256).alias("all_switches"),
        F.sha2(dedup.normalize_key(c, ignore_case=False, collapse=False), 256).alias("trim_only"),
        F.sha2(dedup.normalize_key(c, trim=False, collapse=False), 256).alias("case_only"),
    )


def _report_sql(cte: str, table: str) -> str:
    return f"""WITH {cte} SELECT min(row_number) AS first_row, max(row_number) AS last_row, count(*) AS occurrences
      FROM {table} WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1"""


def _occurrences_sql(cte: str, table: str, tail: str = "") -> str:
    return f"""WITH {cte}, r AS (SELECT k, min(row_number) AS first_row, count(*) AS n FROM {table} WHERE k IS NOT NULL
      GROUP BY k HAVING count(*) > 1 {tail})
    SELECT first_row, row_number, row_number() OVER (PARTITION BY first_row ORDER BY row_number) AS occurrence
    FROM {table} t JOIN r ON t.k = r.k"""


@query("dup_report", _report_sql(DOCS_SQL, "docs"))
def dup_report(spark, folder):
    return dedup.duplicate_report(documents(spark, folder), _text_key(), long_keys=True)


@query("dup_occurrences", _occurrences_sql(DOCS_SQL, "docs"))
def dup_occurrences(spark, folder):
    return dedup.duplicate_occurrences(documents(spark, folder), _text_key(), long_keys=True, slice_rows=256)


@query("dup_report_contacts", _report_sql(KEYED_SQL, "keyed"))
def dup_report_contacts(spark, folder):
    return dedup.duplicate_report(contacts(spark, folder), _email_key())


@query("dup_occurrences_contacts", _occurrences_sql(KEYED_SQL, "keyed"))
def dup_occurrences_contacts(spark, folder):
    return dedup.duplicate_occurrences(contacts(spark, folder), _email_key(), slice_rows=256)


@query("dup_samples", _occurrences_sql(DOCS_SQL, "docs", "ORDER BY n DESC, first_row LIMIT 10"))
def dup_samples(spark, folder):
    return dedup.duplicate_occurrences(documents(spark, folder), _text_key(), top=10, long_keys=True)


def _totals_sql(cte: str, table: str) -> str:
    return f"""WITH {cte}, g AS (SELECT count(*) AS n FROM {table}
      GROUP BY coalesce(k, ''), CASE WHEN k IS NULL THEN row_number END)
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
      CAST(sum(n - 1) AS BIGINT) AS skipped_rows, count(*) FILTER (n > 1) AS duplicate_keys,
      count(*) FILTER (n = 2) AS two_occurrences, count(*) FILTER (n BETWEEN 3 AND 5) AS three_to_five,
      count(*) FILTER (n > 5) AS more_than_five,
      floor(sum(n - 1) / CAST(sum(n) AS DOUBLE) * 100 * 100 + 0.5) / 100.0 AS duplicate_rate FROM g"""


@query("dup_histogram", _totals_sql(DOCS_SQL, "docs"))
def dup_histogram(spark, folder):
    return dedup.dedup_totals(documents(spark, folder), _text_key(), long_keys=True)


@query("dup_totals_contacts", _totals_sql(KEYED_SQL, "keyed"))
def dup_totals_contacts(spark, folder):
    return dedup.dedup_totals(contacts(spark, folder), _email_key())


@query(
    "running_duplicates",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS seen,
      CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS total FROM events""",
)
def running_duplicates(spark, folder):
    from rowmill.functions.ordered import running_totals

    rows = read(spark, folder, "events").select(
        "event_id", "event_type", F.floor("value").cast("bigint").alias("v"), row_slice(F.col("event_id"), 1000).alias("s")
    )
    out = running_totals(rows, ["event_type"], "s", [F.col("event_id")], {"seen": F.lit(1), "total": F.col("v")})
    return out.select("event_id", "seen", "total")
