"""Queries: row validation and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import ACTIONS_SQL, CONTACTS_SQL, actions, contacts
from rowmill.catalog.registry import query, read
from rowmill.functions import text
from rowmill.operators import lifecycle, validate
from rowmill.spec import SECURITY_PATTERNS

_S = r"[\s\x0B\p{Z}\x{FEFF}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_S}+', ''), '{_S}+$', '')"


def _int(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '^{_S}*([+-]?[0-9]+)', 1), '') AS BIGINT)"


def _case(cond: str, field: str, value: str, code: str, message: str) -> str:
    message = message.replace("'", "''")
    return f"CASE WHEN {cond} THEN '{field}|' || {value} || '|{code}|{message}' END"


def _shown(c: str) -> str:
    return f"CASE WHEN CAST({c} AS VARCHAR) = '0' THEN '' ELSE coalesce(CAST({c} AS VARCHAR), '') END"


_SHAPE = r"'^[^\s\x0B\p{Z}\x{FEFF}@]+@[^\s\x0B\p{Z}\x{FEFF}@]+\.[^\s\x0B\p{Z}\x{FEFF}@]+$'"
_STRICT = r"""regexp_matches(email_c, '^[a-zA-Z0-9_''+.\-]*[a-zA-Z0-9_+\-]@([a-zA-Z0-9][a-zA-Z0-9\-]*[.])+[a-zA-Z]{2,}$')
 AND NOT starts_with(email_c, '.') AND NOT contains(email_c, '..')"""
_PATTERNS = [
    ("^=", "Excel formula detected"),
    ("^@", "Excel function detected"),
    ("^[+]", "Excel formula detected"),
    ("^-", "Excel formula detected"),
    ("(?i)<script", "Script tag detected"),
    ("(?i)javascript:", "JavaScript protocol detected"),
    (r"(?i)data:[^\n\r\x{2028}\x{2029}]*base64", "Base64 data URI detected"),
]
_CHECKS = [
    _case("id = ''", "id", "id", "REQUIRED_FIELD_MISSING", "Required field 'id' is missing or empty"),
    _case(
        f"email <> '' AND NOT regexp_matches(email, {_SHAPE})",
        "email", "email", "INVALID_EMAIL_FORMAT", "Invalid email format",
    ),
    _case(
        "length(email) > 255", "email", "substr(email, 1, 50) || '...'", "FIELD_TOO_LONG",
        "Field 'email' exceeds maximum length of 255",
    ),
    _case(
        "name <> '' AND NOT length(name) BETWEEN 1 AND 255", "name", "name", "DATA_TYPE_MISMATCH",
        "Name must be between 1 and 255 characters",
    ),
    _case(
        "length(name) > 255", "name", "substr(name, 1, 50) || '...'", "FIELD_TOO_LONG",
        "Field 'name' exceeds maximum length of 255",
    ),
    _case(
        "age <> '' AND (age_c IS NULL OR NOT age_c BETWEEN 1 AND 150)", "age", "age", "INVALID_AGE_RANGE",
        "Age must be a number between 1 and 150",
    ),
    _case("name = ''", "name", "''", "DATA_TYPE_MISMATCH", "Name cannot be empty"),
    _case("length(name) > 255", "name", "name", "DATA_TYPE_MISMATCH", "Name too long"),
    _case(f"NOT ({_STRICT})", "email", "email_c", "DATA_TYPE_MISMATCH", "Invalid email format"),
    _case("age_c IS NULL", "age", "''", "DATA_TYPE_MISMATCH", "Expected number, received nan"),
    _case("age_c < 1", "age", _shown("age_c"), "DATA_TYPE_MISMATCH", "Number must be greater than or equal to 1"),
    _case("age_c > 150", "age", _shown("age_c"), "DATA_TYPE_MISMATCH", "Number must be less than or equal to 150"),
    _case(
        "age_c <> 0 AND name = ''", "age,name", _shown("age_c") + " || ',' || name", "BUSINESS_RULE_VIOLATION",
        "Name is required when age is provided",
    ),
] + [
    _case(f"regexp_matches({c}, '{p}')", c, c, "SUSPICIOUS_CONTENT", f"Security violation: {m}")
    for c in ("email", "name", "age", "id", "segment")
    for p, m in _PATTERNS
]
CHECKED_SQL = f"""{CONTACTS_SQL},
mapped AS (SELECT row_number, {', '.join(f"{_strip(c)} AS {c}" for c in ('email', 'name', 'age', 'id', 'segment'))}
  FROM contacts),
cleaned AS (SELECT *, lower(email) AS email_c, {_int('age')} AS age_c FROM mapped),
checked AS (SELECT row_number, id, email_c AS email, name, age_c AS age, segment,
  list_filter([{', '.join(_CHECKS)}], lambda x: x IS NOT NULL) AS errors,
  CASE WHEN name <> '' AND regexp_matches(name, '[\\x00-\\x1F\\x7F-\\x{{9F}}]') THEN 1 ELSE 0 END AS warnings
  FROM cleaned)"""


@query(
    "validate_contacts",
    f"""WITH {CHECKED_SQL}
    SELECT row_number, id, email, name, age, segment, len(errors) = 0 AS is_valid,
      array_to_string(errors, ';') AS errors, CAST(warnings AS INTEGER) AS warnings FROM checked""",
)
def validate_contacts(spark, folder):
    checked = validate.validate(contacts(spark, folder))
    listed = F.transform("errors", lambda e: F.concat_ws("|", e["field"], e["value"], e["code"], e["message"]))
    return checked.select(
        "row_number", "id", "email", "name", "age", "segment", "is_valid",
        F.array_join(listed, ";").alias("errors"), F.size("warnings").alias("warnings"),
    )


@query(
    "validation_totals",
    f"""WITH {CHECKED_SQL} SELECT count(*) AS total_rows, count(*) FILTER (len(errors) = 0) AS valid_rows,
      count(*) FILTER (len(errors) > 0) AS invalid_rows, CAST(sum(len(errors)) AS BIGINT) AS total_errors,
      CAST(sum(warnings) AS BIGINT) AS total_warnings FROM checked""",
)
def validation_totals(spark, folder):
    return validate.validation_totals(validate.validate(contacts(spark, folder)))


def _breakdown_sql(part: int, name: str) -> str:
    return f"""WITH {CHECKED_SQL}, e AS (SELECT unnest(errors) AS x FROM checked)
    SELECT {name}, count(*) AS errors FROM (
      SELECT CASE WHEN {part} > 0 THEN string_split(x, '|')[{part}] ELSE
        regexp_extract(x, '[|]([^|]*)$', 1) END AS {name} FROM e) GROUP BY 1"""


@query("validation_by_code", _breakdown_sql(3, "code"))
def validation_by_code(spark, folder):
    return validate.error_breakdown(validate.validate(contacts(spark, folder)), "code")


@query("validation_by_field", _breakdown_sql(1, "field"))
def validation_by_field(spark, folder):
    return validate.error_breakdown(validate.validate(contacts(spark, folder)), "field")


@query("error_summary", _breakdown_sql(0, "message"))
def error_summary(spark, folder):
    return validate.error_breakdown(validate.validate(contacts(spark, folder)), "message")


@query(
    "error_samples",
    f"""WITH {CHECKED_SQL}, e AS (SELECT row_number, unnest(errors) AS x, unnest(range(len(errors))) AS position FROM checked)
    SELECT row_number, CAST(position AS INTEGER) AS position, string_split(x, '|')[1] AS field,
      string_split(x, '|')[2] AS value, string_split(x, '|')[3] AS code, string_split(x, '|')[4] AS message,
      'error' AS severity FROM e ORDER BY row_number, position LIMIT 10""",
)
def error_samples(spark, folder):
    return validate.error_samples(validate.validate(contacts(spark, folder)), 10)


@query(
    "error_rate_gate",
    f"""WITH {CHECKED_SQL} SELECT count(*) AS total_rows, count(*) FILTER (len(errors) > 0) AS invalid_rows,
      count(*) FILTER (len(errors) > 0) / CAST(count(*) AS DOUBLE) AS error_rate,
      count(*) FILTER (len(errors) > 0) <= count(*) * 0.1 AS passes FROM checked""",
)
def error_rate_gate(spark, folder):
    return validate.error_rate(validate.validate(contacts(spark, folder)), 0.1)


@query(
    "quarantine",
    f"""WITH {CHECKED_SQL} SELECT row_number, CAST(len(errors) AS INTEGER) AS n_errors,
      string_split(errors[1], '|')[3] AS first_code FROM checked WHERE len(errors) > 0""",
)
def quarantine(spark, folder):
    rows = validate.quarantined_rows(validate.validate(contacts(spark, folder)))
    return rows.select("row_number", F.size("errors").alias("n_errors"), F.col("errors")[0]["code"].alias("first_code"))


@query(
    "validate_limited_errors",
    f"""WITH {CHECKED_SQL} SELECT row_number, array_to_string(list_transform(errors[1:2],
      lambda x: string_split(x, '|')[3]), ';') AS codes FROM checked""",
)
def validate_limited_errors(spark, folder):
    rows = validate.validate(contacts(spark, folder), max_errors=2)
    return rows.select("row_number", F.array_join(F.col("errors.code"), ";").alias("codes"))


# Strict mode leaves the unknown column out; an empty optional cell may be read as absent.
_STRICT_CHECKS = [c for c in _CHECKS if not c.startswith("CASE WHEN regexp_matches(segment")]


@query(
    "validate_strict",
    f"""WITH {CONTACTS_SQL},
    mapped AS (SELECT row_number, {', '.join(f"{_strip(c)} AS {c}" for c in ('email', 'name', 'age', 'id'))} FROM contacts),
    cleaned AS (SELECT *, lower(email) AS email_c, {_int('age')} AS age_c FROM mapped)
    SELECT row_number, len(list_filter([{', '.join(_STRICT_CHECKS)}], lambda x: x IS NOT NULL)) = 0 AS is_valid FROM cleaned""",
)
def validate_strict(spark, folder):
    return validate.validate(contacts(spark, folder), strict=True).select("row_number", "is_valid")


_LENIENT_CHECKS = [
    c.replace("name = ''", "name IS NULL").replace("name IS NULL\" THEN", "false")
    for c in _CHECKS
    if "Name cannot be empty" not in c and "received nan" not in c
] + [_case("age IS NOT NULL AND age_c IS NULL", "age", "''", "DATA_TYPE_MISMATCH", "Expected number, received nan")]


@query(
    "validate_empty_as_absent",
    f"""WITH {CONTACTS_SQL},
    mapped AS (SELECT row_number, {_strip('email')} AS email, nullif({_strip('name')}, '') AS name,
      nullif({_strip('age')}, '') AS age, {_strip('id')} AS id, {_strip('segment')} AS segment FROM contacts),
    cleaned AS (SELECT *, lower(email) AS email_c, {_int('age')} AS age_c FROM mapped)
    SELECT row_number, CAST(len(list_filter([{', '.join(c.replace("|| ',' || name", "|| ','") for c in _LENIENT_CHECKS)}],
      lambda x: x IS NOT NULL)) AS INTEGER) AS n_errors FROM cleaned""",
)
def validate_empty_as_absent(spark, folder):
    rows = validate.validate(contacts(spark, folder), empty_optional="null")
    return rows.select("row_number", F.size("errors").alias("n_errors"))


@query(
    "map_fields",
    f"""WITH base AS (SELECT c_custkey + 1 AS row_number, c_custkey, c_name, c_mktsegment FROM customer)
    SELECT row_number, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'first ' || c_custkey END,
      CASE WHEN c_custkey % 3 = 0 THEN {_strip("chr(9) || 'full ' || c_custkey")} END, c_name) AS name,
      'u' || c_custkey || '@x.io' AS email, 'segment=' || c_mktsegment AS extras FROM base""",
)
def map_fields(spark, folder):
    rows = read(spark, folder, "customer").select(
        (F.col("c_custkey") + 1).alias("row_number"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\tfull "), F.col("c_custkey"))).alias("Full_Name"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("first "), F.col("c_custkey"))).alias("first_name"),
        F.concat(F.lit(" u"), F.col("c_custkey"), F.lit("@x.io")).alias("EMAIL"),
        F.col("c_mktsegment").alias(" Segment "),
    )
    mapped = validate.pack_extras(validate.map_fields(rows))
    pairs = F.transform(F.map_entries("extras"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return mapped.select("row_number", "name", "email", F.array_join(pairs, ";").alias("extras"))


def _scan_sql(column: str, table: str, key: str) -> str:
    return f"""SELECT {key}, array_to_string(list_filter([{', '.join(
        f"CASE WHEN regexp_matches({column}, '{p}') THEN '{m}' END" for p, m in _PATTERNS)}], lambda x: x IS NOT NULL), ';')
        AS findings FROM {table}"""


def _findings(column):
    errors = validate.security_errors([column])[0]
    messages = F.transform(errors, lambda e: F.replace(e["message"], F.lit("Security violation: "), F.lit("")))
    return F.array_join(messages, ";").alias("findings")


@query("security_scan_documents", _scan_sql("text", "documents", "doc_id"))
def security_scan_documents(spark, folder):
    return read(spark, folder, "documents").select("doc_id", _findings("text"))


@query("security_scan_pages", _scan_sql("html", "pages", "page_id"))
def security_scan_pages(spark, folder):
    return read(spark, folder, "pages").select("page_id", _findings("html"))


@query(
    "text_warnings",
    f"""SELECT doc_id, regexp_matches(text, '[\\x00-\\x1F\\x7F-\\x{{9F}}]') AS has_control,
      length({_strip("padded")}) < length(padded) * 0.8 AS has_loose_space
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN repeat(' ', n_chars) || text ELSE text END AS padded FROM documents)""",
)
def text_warnings(spark, folder):
    wide = F.concat(F.repeat(F.lit(" "), F.col("n_chars").cast("int")), "text")
    padded = F.when(F.col("doc_id") % 3 == 0, wide).otherwise(F.col("text"))
    return read(spark, folder, "documents").select(
        "doc_id",
        text.has_control_chars(F.col("text")).alias("has_control"),
        text.has_loose_space(padded).alias("has_loose_space"),
    )


@query(
    "record_check",
    f"""WITH {CHECKED_SQL}, v AS (SELECT row_number, email AS email_c, name, age AS age_c FROM checked),
    f AS (SELECT row_number, list_filter([
      CASE WHEN name = '' THEN 'name: Name cannot be empty' END,
      CASE WHEN length(name) > 255 THEN 'name: Name too long' END,
      CASE WHEN NOT ({_STRICT}) THEN 'email: Invalid email format' END,
      CASE WHEN age_c < 1 THEN 'age: Number must be greater than or equal to 1' END,
      CASE WHEN age_c > 150 THEN 'age: Number must be less than or equal to 150' END], lambda x: x IS NOT NULL) AS p FROM v)
    SELECT row_number, CASE WHEN len(p) > 0 THEN 'Validation failed: ' || array_to_string(p, ', ') END AS problem FROM f""",
)
def record_check(spark, folder):
    rows = validate.update_records(contacts(spark, folder))
    return validate.check_records(rows).select("row_number", "problem")


@query(
    "update_records",
    f"""WITH {CONTACTS_SQL} SELECT row_number, {_strip('id')} AS id, lower({_strip('email')}) AS email,
      {_strip('name')} AS name, CAST({_int('age')} AS INTEGER) AS age FROM contacts""",
)
def update_records(spark, folder):
    return validate.update_records(contacts(spark, folder)).select("row_number", "id", "email", "name", "age")


@query(
    "action_checks",
    f"""WITH {ACTIONS_SQL} SELECT id, array_to_string(list_filter([
      CASE WHEN account_id = '' THEN 'Account ID is required' END,
      CASE WHEN account_id <> '' AND NOT regexp_matches(account_id, '^[a-zA-Z0-9_-]+$') THEN 'Invalid account ID format' END,
      CASE WHEN entity_type <> 'contact' THEN 'Invalid entity type' END,
      CASE WHEN action_type <> 'bulk_update' THEN 'Invalid action type' END,
      CASE WHEN total_entities < 0 THEN 'Total entities cannot be negative' END,
      CASE WHEN scheduled_at <= TIMESTAMP '1998-01-01' THEN 'Scheduled time must be in the future' END,
      CASE WHEN configuration LIKE '%merge%' THEN 'Invalid conflict mode' END], lambda x: x IS NOT NULL), ';') AS problems
    FROM actions""",
)
def action_checks(spark, folder):
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    rows = lifecycle.check_actions(actions(spark, folder), now, uuid_key=False)
    return rows.select("id", F.array_join("problems", ";").alias("problems"))


@query(
    "job_checks",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([
      CASE WHEN l_linenumber = 3 THEN 'action_id is required' END,
      CASE WHEN l_returnflag = 'R' THEN 'chunk_path is required' END,
      CASE WHEN l_quantity - 10 < 0 THEN 'record_count cannot be negative' END,
      CASE WHEN l_linenumber - 1 < 1 THEN 'total_chunks must be at least 1' END], lambda x: x IS NOT NULL), ';') AS problems
    FROM lineitem""",
)
def job_checks(spark, folder):
    rows = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linenumber") != 3, F.concat(F.lit("a-"), F.col("l_orderkey"))).alias("action_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise("path").alias("chunk_path"),
        (F.col("l_quantity") - 10).alias("record_count"),
        (F.col("l_linenumber") - 1).alias("total_chunks"),
    )
    checked = lifecycle.check_jobs(rows)
    return checked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("problems", ";").alias("problems")
    )


@query(
    "progress_checks",
    f"""WITH {ACTIONS_SQL} SELECT id, CASE WHEN total_entities - 2000 < 0 THEN 'Processed entities cannot be negative'
      ELSE '' END AS problems FROM actions""",
)
def progress_checks(spark, folder):
    rows = actions(spark, folder).withColumn("processed_entities", F.col("total_entities") - 2000)
    return lifecycle.check_progress(rows).select("id", F.array_join("problems", ";").alias("problems"))


_RETRY = "timeout|connection|network|temporary|rate limit|deadlock|lock"


@query(
    "retry_classification",
    f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN false WHEN lang = 'es' THEN true
      ELSE regexp_matches(text, '(?i){_RETRY}') END AS retryable,
      CASE lang WHEN 'fr' THEN 'validation' WHEN 'de' THEN 'storage' ELSE 'processing' END AS stage FROM documents""",
)
def retry_classification(spark, folder):
    kind = F.when(F.col("lang") == "fr", "validation").when(F.col("lang") == "de", "database").otherwise("other")
    message = F.when(F.col("lang") != "es", F.col("text"))
    return read(spark, folder, "documents").select(
        "doc_id",
        lifecycle.is_retryable(kind, message).alias("retryable"),
        lifecycle.error_stage(kind).alias("stage"),
    )
