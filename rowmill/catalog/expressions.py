"""Queries: scalar expressions and file descriptions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import ACTIONS_SQL, CONTACTS_SQL, actions, contacts
from rowmill.catalog.registry import query, read
from rowmill.functions import json, numbers, ring, text
from rowmill.operators import chunking, lifecycle
from rowmill.sources import files, seeds

_S = r"[\s\x0B\p{Z}\x{FEFF}]"


@query(
    "email_parts",
    f"""WITH {CONTACTS_SQL} SELECT row_number, coalesce(string_split(email, '@')[2], '') AS domain,
      coalesce(nullif(name, ''), nullif(string_split(email, '@')[1], ''), 'Unknown Contact') AS display_name FROM contacts""",
)
def email_parts(spark, folder):
    return contacts(spark, folder).select(
        "row_number",
        text.email_domain(F.col("email")).alias("domain"),
        text.display_name(F.col("name"), F.col("email")).alias("display_name"),
    )


@query(
    "mask_secrets",
    f"""WITH t AS (SELECT doc_id, 'Password = ''' || lang || ''' and TOKEN=''' || source || ''' ' || text AS q FROM documents)
    SELECT doc_id, substr(regexp_replace(regexp_replace(q, '(?i)password{_S}*={_S}*''[^'']*''', 'password=''***''', 'g'),
      '(?i)token{_S}*={_S}*''[^'']*''', 'token=''***''', 'g'), 1, 200) || CASE WHEN length(q) > 200 THEN '...' ELSE '' END AS masked
    FROM t""",
)
def mask_secrets(spark, folder):
    logged = F.concat(
        F.lit("Password = '"), "lang", F.lit("' and TOKEN='"), "source", F.lit("' "), "text"
    )
    return read(spark, folder, "documents").select("doc_id", text.mask_secrets(logged).alias("masked"))


@query(
    "shortened_texts",
    "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown FROM documents",
)
def shortened_texts(spark, folder):
    return read(spark, folder, "documents").select("doc_id", text.shorten(F.col("text"), 50).alias("shown"))


@query(
    "parse_numbers",
    f"""WITH {CONTACTS_SQL}, v AS (SELECT row_number, age, age || '.7' AS d, '0x1F' || age AS h FROM contacts)
    SELECT row_number, {', '.join(f"TRY_CAST(nullif(regexp_extract({c}, '^{_S}*([+-]?[0-9]+)', 1), '') AS BIGINT) AS {c}_n" for c in 'age d h'.split())}
    FROM v""",
)
def parse_numbers(spark, folder):
    age = F.col("age")
    return contacts(spark, folder).select(
        "row_number",
        numbers.parse_int(age).alias("age_n"),
        numbers.parse_int(F.concat(age, F.lit(".7"))).alias("d_n"),
        numbers.parse_int(F.concat(F.lit("0x1F"), age)).alias("h_n"),
    )


@query(
    "action_config",
    f"""WITH {ACTIONS_SQL}, c AS (SELECT id, CASE WHEN configuration LIKE '{{%' THEN CAST(configuration AS JSON) END AS j FROM actions)
    SELECT id, coalesce(CAST(j->>'deduplicate' AS BOOLEAN), CAST(j->>'deduplication' AS BOOLEAN), false) AS deduplicate,
      coalesce(j->>'onConflict', 'skip') AS on_conflict, j->>'filePath' AS file_path FROM c""",
)
def action_config(spark, folder):
    settings = lifecycle.action_config(F.col("configuration"))
    return actions(spark, folder).select("id", *[c.alias(name) for name, c in settings.items()])


@query(
    "json_config",
    """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM
      (SELECT event_id, CAST(props AS JSON) AS props FROM events)""",
)
def json_config(spark, folder):
    parsed = F.from_json("props", "k bigint")
    return read(spark, folder, "events").select(
        "event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.missing").alias("missing")
    )


@query(
    "coercions",
    """SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS items, o_orderkey % 3 = 0 AS flag,
      CASE WHEN o_orderkey % 4 <> 0 THEN epoch_ms(o_orderdate) END AS at_ms FROM orders""",
)
def coercions(spark, folder):
    key = F.col("o_orderkey")
    listed = F.concat(F.lit(" "), "o_orderstatus", F.lit(" ,\t"), "o_orderpriority", F.lit(" "))
    stamp = F.when(key % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("not a date")
    return read(spark, folder, "orders").select(
        "o_orderkey",
        F.array_join(text.split_list(listed), "|").alias("items"),
        text.to_flag(F.when(key % 3 == 0, "true").when(key % 3 == 1, "TRUE")).alias("flag"),
        F.unix_millis(numbers.try_instant(stamp)).alias("at_ms"),
    )


@query(
    "sanitized_names",
    """WITH n AS (SELECT p_partkey, ' __' || p_name || ' (' || p_brand || ')--' || p_type || '! ' AS n FROM part)
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(n)), '[^a-z0-9_]', '_', 'g'),
      '_{2,}', '_', 'g'), '^_', ''), '_$', '') AS name FROM n""",
)
def sanitized_names(spark, folder):
    raw = F.concat(F.lit(" __"), "p_name", F.lit(" ("), "p_brand", F.lit(")--"), "p_type", F.lit("! "))
    return read(spark, folder, "part").select("p_partkey", text.sanitize_name(raw).alias("name"))


@query(
    "digests",
    """SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256,
      CAST(CAST(('0x' || substr(sha256(text), 1, 16)) AS UBIGINT) AS VARCHAR) AS hash64, length(text) AS units FROM documents""",
)
def digests(spark, folder):
    c = F.col("text")
    return read(spark, folder, "documents").select(
        "doc_id",
        ring.digest(c, "md5").alias("md5"),
        ring.digest(c, "sha1").alias("sha1"),
        ring.digest(c).alias("sha256"),
        ring.hash64(c).cast("string").alias("hash64"),
        text.unit_length(c).cast("bigint").alias("units"),
    )


@query(
    "row_sizes",
    """SELECT c_custkey, CAST(length(c_name) + coalesce(length(c_mktsegment), 0) + length(CAST(c_custkey AS VARCHAR))
      + 7 + 13 + 10 + 10 AS BIGINT) AS size FROM customer""",
)
def row_sizes(spark, folder):
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    return read(spark, folder, "customer").select("c_custkey", chunking.row_size(columns).alias("size"))


@query(
    "size_estimates",
    """SELECT doc_id, greatest(0, CAST(floor(n_chars / 20) AS BIGINT) - 1) AS entities,
      CAST(ceil(n_chars / 150) AS BIGINT) AS rows FROM documents""",
)
def size_estimates(spark, folder):
    size = F.col("n_chars")
    return read(spark, folder, "documents").select(
        "doc_id", files.estimate_entities(size).alias("entities"), files.estimate_rows(size).alias("rows")
    )


@query(
    "storage_paths",
    """WITH p AS (SELECT o_orderkey, 'acct-' || o_custkey AS a, 'a-' || o_orderkey AS i, CASE o_orderkey % 6
      WHEN 0 THEN '/raw.csv' WHEN 1 THEN '/Chunks/job/chunk' || (o_orderkey % 40) || '.csv'
      WHEN 2 THEN '/Chunks/processing/chunk_007.csv'
      WHEN 3 THEN '/Chunks/processing/chunk_007_00000000000000ff-0fffffffffffffff.csv'
      WHEN 4 THEN '/processing/part' ELSE '/other.csv' END AS t FROM orders)
    SELECT o_orderkey, 'private/Accounts/' || a || '/Action/' || i || t AS path,
      CASE WHEN o_orderkey % 6 < 5 THEN a END AS account_id, CASE WHEN o_orderkey % 6 < 5 THEN i END AS action_id,
      CASE o_orderkey % 6 WHEN 0 THEN 'raw' WHEN 4 THEN 'processing' WHEN 5 THEN NULL ELSE 'chunk' END AS kind FROM p""",
)
def storage_paths(spark, folder):
    key = F.col("o_orderkey")
    account, action = F.concat(F.lit("acct-"), "o_custkey"), F.concat(F.lit("a-"), key)
    span = (F.lit("00000000000000ff"), F.lit("0fffffffffffffff"))
    kind = key % 6
    path = (
        F.when(kind == 0, files.raw_path(account, action))
        .when(kind == 1, files.chunk_path(account, action, F.lit("job"), key % 40))
        .when(kind == 2, files.processing_path(account, action, chunking.chunk_file_name(F.lit(7), *span)))
        .when(kind == 3, files.processing_path(account, action, chunking.chunk_file_name(F.lit(7), *span, "hybrid")))
        .when(kind == 4, F.regexp_replace(files.raw_path(account, action), "raw.csv", "processing/part"))
        .otherwise(F.regexp_replace(files.raw_path(account, action), "raw.csv", "other.csv"))
    )
    rows = read(spark, folder, "orders").select("o_orderkey", path.alias("path"))
    return rows.withColumns(files.parse_path(F.col("path")))


@query(
    "file_gate",
    """WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'p.CSV' WHEN 1 THEN 'p.txt' WHEN 2 THEN '../p.csv'
        WHEN 3 THEN 'p.exe' ELSE 'csv' END AS name,
      CASE page_id % 3 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/plain' ELSE 'text/html' END AS content_type,
      CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(html) END AS length FROM pages)
    SELECT page_id, concat_ws(';', CASE WHEN content_type = 'text/html' THEN 'Invalid file type' END,
      CASE WHEN name = 'p.exe' THEN 'Invalid file extension' END, CASE WHEN name = '../p.csv' THEN 'Invalid filename' END,
      CASE WHEN length > 2000 THEN 'File size limit exceeded' END, CASE WHEN length = 0 THEN 'Uploaded file is empty' END) AS reasons
    FROM f""",
)
def file_gate(spark, folder):
    key = F.col("page_id")
    name = (
        F.when(key % 5 == 0, "p.CSV").when(key % 5 == 1, "p.txt").when(key % 5 == 2, "../p.csv")
        .when(key % 5 == 3, "p.exe").otherwise("csv")
    )
    kind = F.when(key % 3 == 0, "text/csv").when(key % 3 == 1, "text/plain").otherwise("text/html")
    size = F.when(key % 7 == 0, 0).otherwise(F.length("html"))
    rows = read(spark, folder, "pages").select(
        "page_id", name.alias("name"), kind.alias("content_type"), size.alias("length")
    )
    checked = files.check_files(rows, max_bytes=2000)
    return checked.select("page_id", F.array_join("reasons", ";").alias("reasons"))


def _uuid_sql(c: str) -> str:
    return "(" + " || '-' || ".join(
        f"substr(md5({c}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    ) + ")"


def _draw_sql(key: str, salt: str, low: str, high: str) -> str:
    bits = f"CAST(CAST(('0x' || substr(md5({key} || '|{salt}'), 1, 8)) AS UBIGINT) AS BIGINT)"
    return f"(({low}) + {bits} % greatest(({high}) - ({low}) + 1, 1))"


def _pick_sql(key: str, salt: str, values) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[{_draw_sql(key, salt, '0', str(len(values) - 1))} + 1]"


@query(
    "synthetic_contacts",
    f"""WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer)
    SELECT {_uuid_sql("'contact-' || k")} AS id, {_pick_sql('k', 'first', seeds.FIRST_NAMES)} || ' ' ||
      {_pick_sql('k', 'last', seeds.LAST_NAMES)} AS name, 'contact' || k || '@example.com' AS email,
      CAST({_draw_sql('k', 'age', '18', '80')} AS INTEGER) AS age FROM k""",
)
def synthetic_contacts(spark, folder):
    return seeds.synthetic_contacts(read(spark, folder, "customer"), "c_custkey")


@query(
    "synthetic_stats",
    f"""WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders),
    a AS (SELECT k, {_pick_sql('k', 'status', seeds.STATUSES)} AS status, {_draw_sql('k', 'total', '100', '5000')} AS t FROM k),
    b AS (SELECT *, CASE status WHEN 'completed' THEN t WHEN 'failed' THEN {_draw_sql('k', 'done', '0', 't - 1')}
      WHEN 'processing' THEN {_draw_sql('k', 'done', '0', 't')} WHEN 'cancelled' THEN {_draw_sql('k', 'done', '0', 't // 2')}
      ELSE 0 END AS good FROM a),
    c AS (SELECT *, CASE WHEN status = 'failed' THEN t - good WHEN status IN ('processing', 'validating')
      THEN {_draw_sql('k', 'failed', '0', 't // 5')} ELSE 0 END AS bad FROM b)
    SELECT {_uuid_sql("'action-' || k")} AS action_id, t AS total_records, good AS successful_records, bad AS failed_records,
      CASE WHEN status = 'failed' THEN {_draw_sql('k', 'skipped', '0', 'bad // 2')} WHEN status = 'cancelled' THEN t - good
        WHEN status IN ('processing', 'validating') THEN {_draw_sql('k', 'skipped', '0', 't // 10')} ELSE 0 END AS skipped_records
    FROM c""",
)
def synthetic_stats(spark, folder):
    return seeds.synthetic_stats(seeds.synthetic_actions(read(spark, folder, "orders"), "o_orderkey"))


@query(
    "synthetic_actions",
    f"""WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders)
    SELECT {_uuid_sql("'action-' || k")} AS id, {_pick_sql('k', 'account', ('account-1', 'account-2'))} AS account_id,
      {_pick_sql('k', 'status', seeds.STATUSES)} AS status,
      '{{"deduplication":' || {_pick_sql('k', 'dedup', ('true', 'false'))} || '}}' AS configuration,
      {_draw_sql('k', 'size', '1000', '1000000')} AS file_size, {_draw_sql('k', 'priority', '1', '10')} AS priority FROM k""",
)
def synthetic_actions(spark, folder):
    rows = seeds.synthetic_actions(read(spark, folder, "orders"), "o_orderkey")
    return rows.select("id", "account_id", "status", "configuration", "file_size", "priority")


@query(
    "update_file",
    """SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR) || '|update'), 1, 10) AS c_name FROM customer""",
)
def update_file(spark, folder):
    rows = seeds.update_file(read(spark, folder, "customer"), "c_name", "c_custkey", order="c_custkey")
    return rows.select("c_custkey", "c_name")


_PATCH = """CASE o_orderkey % 6 WHEN 0 THEN '{"onConflict":null,"retry":{"max":' || CAST(o_orderkey % 9 AS STRING) || ',"delays":[[1,2.5],[4]]}}'
    WHEN 1 THEN '{"deduplicate":false,"retry":{"max":null}}' WHEN 2 THEN '[1]' WHEN 3 THEN '{"retry":{"delays":[[10],[],[0.5,' || CAST(o_orderkey % 7 AS STRING) || ']]}}'
    ELSE '{"filePath":"x.csv","retry":{"backoff":{"kind":"fixed"}}}' END"""
_STORED = """CASE o_orderkey % 4 WHEN 0 THEN '{"onConflict":"update","retry":{"max":3,"backoff":{"kind":"exponential","ms":100}}}'
    WHEN 1 THEN '{"deduplicate":true}' WHEN 2 THEN 'not json' ELSE '{"retry":5,"zone":"a"}' END"""


@query(
    "config_patched",
    f"""WITH o AS (SELECT o_orderkey, {_STORED} AS stored, {_PATCH} AS patch FROM orders),
    n AS (SELECT o_orderkey, stored, patch, CASE WHEN json_valid(stored) THEN stored ELSE '{{}}' END AS base,
      patch <> '[1]' AS is_patch FROM o),
    m AS (SELECT *, CASE WHEN is_patch THEN CAST(json_merge_patch(base, patch) AS VARCHAR) ELSE stored END AS new FROM n),
    j AS (SELECT *, CASE WHEN json_valid(new) THEN new ELSE '{{}}' END AS doc FROM m)
    SELECT o_orderkey, array_to_string(list_sort(json_keys(doc)), ',') AS names,
      CAST(length(replace(replace(CASE WHEN json_valid(new) THEN CAST(json(doc) AS VARCHAR) ELSE new END, ' ', ''), '.0', '')) AS INTEGER) AS written_chars,
      coalesce(doc ->> '$.onConflict', 'skip') AS on_conflict, coalesce(CAST(doc ->> '$.deduplicate' AS BOOLEAN), FALSE) AS deduplicate,
      CASE WHEN json_type(doc, '$.retry') = 'OBJECT' THEN coalesce(CAST(doc ->> '$.retry.max' AS INTEGER), 1) ELSE 1 END AS retries,
      coalesce(doc ->> '$.retry.backoff.kind', 'none') AS backoff, coalesce(CAST(doc ->> '$.retry.backoff.ms' AS INTEGER), 0) AS backoff_ms,
      coalesce(list_sum(flatten(CAST(doc -> '$.retry.delays' AS DOUBLE[][]))), 0.0::DOUBLE) AS delay_total FROM j""",
)
def config_patched(spark, folder):
    """Nested settings patched, written back as text and read again."""
    orders = read(spark, folder, "orders").selectExpr("o_orderkey", f"{_STORED} AS stored", f"{_PATCH} AS patch")
    new = orders.select("o_orderkey", json.merge_json(F.col("stored"), F.col("patch")).alias("new"))
    return new.select(
        "o_orderkey",
        F.array_join(json.json_keys(F.col("new")), ",").alias("names"),
        F.length(F.replace(F.replace("new", F.lit(" "), F.lit("")), F.lit(".0"), F.lit(""))).alias("written_chars"),
        json.get_or(F.col("new"), "$.onConflict", "string", F.lit("skip")).alias("on_conflict"),
        json.get_or(F.col("new"), "$.deduplicate", "boolean", F.lit(False)).alias("deduplicate"),
        json.get_or(F.col("new"), "$.retry.max", "int", F.lit(1)).alias("retries"),
        json.get_or(F.col("new"), "$.retry.backoff.kind", "string", F.lit("none")).alias("backoff"),
        json.get_or(F.col("new"), "$.retry.backoff.ms", "int", F.lit(0)).alias("backoff_ms"),
        json.total_of_lists(F.col("new"), "$.retry.delays").alias("delay_total"),
    )
