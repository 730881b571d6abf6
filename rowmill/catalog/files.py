"""Queries: delimited files, listings, seeds and snapshots.

The files are written from the given tables into the shared scratch folder and
read back through the sources under test.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowmill.catalog.inputs import ACTIONS_SQL, CONTACTS_SQL, actions, contacts
from rowmill.catalog.registry import query, read
from rowmill.operators import chunking, validate
from rowmill.session import scratch_dir
from rowmill.sources import delimited, files, progress, seeds, tables

_CELLS = [
    "'c' || c_custkey AS id",
    """CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' a "' || c_name || '", b' END AS name""",
    "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_nationkey AS STRING) END AS age",
]


def _write_contacts(spark, folder, purpose):
    path = scratch_dir(spark, purpose)
    rows = read(spark, folder, "customer").selectExpr("c_custkey", *_CELLS)
    # Files in key order, so that the row number in file order is known.
    ordered = rows.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").drop("c_custkey")
    delimited.write_delimited(ordered, path)
    return path


@query(
    "csv_roundtrip",
    f"SELECT row_number() OVER (ORDER BY c_custkey) AS row_number, {', '.join(_CELLS)} FROM customer",
)
def csv_roundtrip(spark, folder):
    rows = delimited.read_delimited(spark, _write_contacts(spark, folder, "csv"))
    return rows.select("row_number", "id", "name", "age")


@query(
    "csv_mixed_headers",
    """SELECT 'c' || c_custkey AS id, c_name AS name,
      CASE WHEN c_custkey % 3 < 2 THEN CAST(c_nationkey AS VARCHAR) END AS age FROM customer""",
)
def csv_mixed_headers(spark, folder):
    """Files with the same columns in another order and spelling, and files without one of them."""
    path = scratch_dir(spark, "csv-mixed")
    cells = ["'c' || c_custkey AS id", "c_name AS name", "CAST(c_nationkey AS STRING) AS age"]
    rows = read(spark, folder, "customer")
    for k, names in enumerate((["id", "name", "age"], ["age", "NAME", "id"], ["Name", "id"])):
        part = rows.filter(F.col("c_custkey") % 3 == k).selectExpr(*cells)
        delimited.write_delimited(part.select(*[F.col(n).alias(n) for n in names]), f"{path}/{k}", files=2)
    return delimited.read_delimited(spark, path, numbered=False).select("id", "name", "age")


@query(
    "csv_first_rows",
    "SELECT c_custkey + 1 AS row_number, 'c' || c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 100",
)
def csv_first_rows(spark, folder):
    rows = delimited.read_delimited(spark, _write_contacts(spark, folder, "csv"), max_rows=100)
    return rows.select("row_number", "id")


_FILE = "'f' || c_nationkey || '_' || CAST(floor(c_custkey / 5000) AS BIGINT)"
_HEADER = """CASE c_nationkey % 8 WHEN 0 THEN 'id,email,name' WHEN 1 THEN '"id", "Email" ,NAME' WHEN 2 THEN 'email,name,age'
    WHEN 3 THEN 'id,email,email' WHEN 4 THEN 'id,,name' WHEN 5 THEN 'id,=cmd,name' WHEN 6 THEN 'id,<SCRIPT>,name'
    ELSE 'id,email,' || repeat('n', 1000) END"""
_LINE = """CASE WHEN c_custkey % 9 = 0 THEN 'c' || c_custkey || ',x' WHEN c_custkey % 7 = 0 THEN 'c' || c_custkey || ',"a, b",y'
    ELSE 'c' || c_custkey || ',x,"say ""hi"" now"' END"""


def _write_uploads(spark, folder):
    """One file per nation and key block, each with a header of its own."""
    path = scratch_dir(spark, "uploads")
    rows = read(spark, folder, "customer").selectExpr(
        f"{_FILE} AS file_id", "c_custkey AS position", f"{_HEADER} AS header", f"{_LINE} AS line"
    )
    headers = rows.groupBy("file_id", "header").agg(F.lit(-1).cast("bigint").alias("position"))
    lines = rows.select("file_id", "position", "line").unionByName(
        headers.select("file_id", "position", F.col("header").alias("line"))
    )
    arranged = lines.repartition("file_id").sortWithinPartitions("file_id", "position")
    arranged.select("file_id", "line").write.partitionBy("file_id").text(path)
    return path


def _file_id(column="file_path"):
    return F.regexp_extract(column, "file_id=([^/]+)/", 1).alias("file_id")


_AUDIT_SQL = f"""h AS (SELECT DISTINCT {_FILE} AS file_id, c_nationkey % 8 AS k FROM customer)"""


@query(
    "header_audit",
    f"""WITH {_AUDIT_SQL} SELECT file_id, CASE k WHEN 0 THEN 'id|email|name' WHEN 1 THEN 'id|email|name' WHEN 2 THEN 'email|name|age'
      WHEN 3 THEN 'id|email|email' WHEN 4 THEN 'id||name' WHEN 5 THEN 'id|=cmd|name' WHEN 6 THEN 'id|<script>|name'
      ELSE 'id|email|' || repeat('n', 1000) END AS names, CASE WHEN k = 2 THEN 'id' ELSE '' END AS missing,
      CASE WHEN k = 3 THEN 'email' ELSE '' END AS duplicates,
      CASE k WHEN 5 THEN '=cmd' WHEN 6 THEN '<SCRIPT>' ELSE '' END AS suspicious, k = 4 AS has_empty_name,
      k = 7 AS is_too_long, k < 2 AS is_valid FROM h""",
)
def header_audit(spark, folder):
    audited = delimited.audit_headers(delimited.header_lines(spark, _write_uploads(spark, folder)))
    return audited.select(
        _file_id(),
        F.array_join("normalized", "|").alias("names"),
        F.array_join("missing", "|").alias("missing"),
        F.array_join("duplicates", "|").alias("duplicates"),
        F.array_join("suspicious", "|").alias("suspicious"),
        "has_empty_name",
        "is_too_long",
        "is_valid",
    )


@query(
    "header_positions",
    f"""WITH {_AUDIT_SQL}, n AS (SELECT file_id, CASE k WHEN 0 THEN ['id','email','name'] WHEN 1 THEN ['id','email','name']
      WHEN 2 THEN ['email','name','age'] WHEN 3 THEN ['id','email','email'] WHEN 4 THEN ['id','','name'] WHEN 5 THEN ['id','=cmd','name']
      WHEN 6 THEN ['id','<script>','name'] ELSE ['id','email',repeat('n', 1000)] END AS l FROM h),
    u AS (SELECT file_id, unnest(l) AS name, unnest([0, 1, 2]) AS position FROM n)
    SELECT file_id, name, CAST(max(position) AS INTEGER) AS position, count(*) AS occurrences FROM u GROUP BY 1, 2""",
)
def header_positions(spark, folder):
    audited = delimited.audit_headers(delimited.header_lines(spark, _write_uploads(spark, folder)))
    return delimited.column_positions(audited).select(_file_id(), "name", "position", "occurrences")


def _structure_sql(bad: str) -> str:
    return f"""WITH l AS (SELECT {_FILE} AS file_id, c_custkey FROM customer)
    SELECT file_id, CAST(3 AS INTEGER) AS expected, count(*) AS data_lines, count(*) FILTER ({bad}) AS bad_lines FROM l GROUP BY file_id"""


@query("structure_check", _structure_sql("c_custkey % 9 = 0"))
def structure_check(spark, folder):
    checked = delimited.check_structure(spark, _write_uploads(spark, folder))
    return checked.select(_file_id(), "expected", "data_lines", "bad_lines")


@query("structure_check_naive", _structure_sql("c_custkey % 9 = 0 OR c_custkey % 7 = 0"))
def structure_check_naive(spark, folder):
    checked = delimited.check_structure(spark, _write_uploads(spark, folder), naive=True)
    return checked.select(_file_id(), "expected", "data_lines", "bad_lines")


@query(
    "file_listing",
    f"""WITH l AS (SELECT {_FILE} AS file_id, length({_LINE}) + 1 AS n, length({_HEADER}) + 1 AS h FROM customer)
    SELECT file_id, CAST(sum(n) + max(h) AS BIGINT) AS length,
      greatest(0, CAST(floor((sum(n) + max(h)) / 20) AS BIGINT) - 1) AS entities FROM l GROUP BY file_id""",
)
def file_listing(spark, folder):
    listing = files.list_files(spark, _write_uploads(spark, folder), "*.txt")
    return listing.select(_file_id("path"), "length", files.estimate_entities(F.col("length")).alias("entities"))


@query(
    "manifest_check",
    f"""WITH h AS (SELECT DISTINCT {_FILE} AS file_id, c_nationkey % 4 AS k FROM customer)
    SELECT file_id, CASE k WHEN 1 THEN 'size mismatch' WHEN 2 THEN 'checksum mismatch' WHEN 3 THEN 'file not found'
      ELSE 'ok' END AS verdict, k = 0 AS is_valid FROM h""",
)
def manifest_check(spark, folder):
    listing = files.file_checksums(spark, _write_uploads(spark, folder), "*.txt").withColumn(
        "file_id", _file_id("path")
    )
    kind = F.regexp_extract("file_id", "^f([0-9]+)_", 1).cast("int") % 4
    manifest = listing.select(
        F.when(kind == 3, F.concat("file_id", F.lit("?"))).otherwise(F.col("file_id")).alias("file_id"),
        (F.col("length") + F.when(kind == 1, 1).otherwise(0)).alias("expected_length"),
        F.when(kind == 2, "0").otherwise(F.col("checksum")).alias("expected_checksum"),
    )
    checked = files.check_manifest(manifest, listing, "file_id")
    return checked.select(F.regexp_replace("file_id", r"\?", "").alias("file_id"), "verdict", "is_valid")


_SPACE = 2**64 - 1


@query(
    "chunk_files",
    f"""SELECT o_orderkey, CAST(least(CAST(CAST(('0x' || substr(sha256('o-' || o_orderkey), 1, 16)) AS UBIGINT) AS HUGEINT)
      // CAST({_SPACE // 20} AS HUGEINT), 19) AS INTEGER) AS chunk_index, o_orderpriority AS priority FROM orders""",
)
def chunk_files(spark, folder):
    path = scratch_dir(spark, "chunks")
    rows = read(spark, folder, "orders").select(
        F.concat(F.lit("o-"), "o_orderkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("priority")
    )
    delimited.write_chunks(chunking.assign_chunks(rows, chunking.ChunkOptions(chunks=20)), path, files_per_chunk=2)
    back = delimited.read_delimited(spark, path, ["id", "o_orderkey", "priority"], numbered=False)
    index = F.regexp_extract("source_file", "chunk_index=([0-9]+)/", 1).cast("int")
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), index.alias("chunk_index"), "priority")


@query(
    "seed_contacts",
    """WITH l AS (SELECT 'c' || c_nationkey AS id, arg_max(c_name, c_custkey) AS name,
      arg_max(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 80 END, c_custkey) AS a FROM customer GROUP BY 1)
    SELECT id, name, CAST(nullif(a, 0) AS INTEGER) AS age FROM l""",
)
def seed_contacts(spark, folder):
    path = scratch_dir(spark, "seed-contacts")
    key = F.col("c_custkey")
    rows = read(spark, folder, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey")
    age = F.when(key % 3 == 0, "0").otherwise(F.concat(key % 80, F.lit("y")))
    delimited.write_delimited(
        rows.select(F.concat(F.lit("c"), "c_nationkey").alias("id"), F.col("c_name").alias("name"), F.lit("e").alias("email"), age.alias("age")),
        path,
    )
    return seeds.load_contacts(delimited.read_delimited(spark, path)).select("id", "name", "age")


@query(
    "seed_actions",
    f"""WITH {ACTIONS_SQL} SELECT id, status, total_entities, epoch_ms(scheduled_at) AS scheduled_ms, configuration,
      CASE WHEN status = 'failed' THEN 'boom, "x"' END AS error_message, CAST(0 AS BIGINT) AS file_size FROM actions""",
)
def seed_actions(spark, folder):
    path = scratch_dir(spark, "seed-actions")
    instant = F.date_format("scheduled_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = actions(spark, folder).select(
        "id", "account_id", "entity_type", "action_type", "status", "total_entities",
        instant.alias("scheduled_at"), F.lit("").alias("started_at"), F.lit("soon").alias("completed_at"),
        "configuration", F.when(F.col("status") == "failed", 'boom, "x"').alias("error_message"),
        F.lit("/uploads/x.csv").alias("file_path"), F.lit("many").alias("file_size"),
    )
    delimited.write_delimited(rows, path)
    loaded = seeds.load_actions(delimited.read_delimited(spark, path))
    return loaded.select(
        "id", "status", "total_entities", F.unix_millis("scheduled_at").alias("scheduled_ms"), "configuration",
        "error_message", "file_size",
    )


@query(
    "seed_load",
    f"""WITH {ACTIONS_SQL}, c AS (SELECT 'contacts' AS name, 'c' || c_nationkey AS id, CAST(max(c_custkey) AS BIGINT) AS value FROM customer GROUP BY 2),
    a AS (SELECT 'actions' AS name, id, total_entities AS value FROM actions),
    s AS (SELECT 'stats' AS name, 'a-' || l_orderkey AS id, CAST(count(*) AS BIGINT) AS value FROM lineitem GROUP BY 2)
    SELECT * FROM c UNION ALL SELECT * FROM a UNION ALL SELECT * FROM s WHERE id IN (SELECT id FROM a)""",
)
def seed_load(spark, folder):
    """The three tables loaded over an earlier load; repeated contacts count by their last row."""
    path = scratch_dir(spark, "seed-load-query")
    people = read(spark, folder, "customer").select(
        F.concat(F.lit("c"), "c_nationkey").alias("id"),
        F.col("c_custkey").cast("string").alias("name"),
        F.lit("e").alias("email"),
        F.lit("x").alias("age"),
        F.col("c_custkey").alias("row_number"),
    )
    text = [F.lit("").alias(c) for c in ("started_at", "completed_at", "error_message", "file_path", "file_size", "scheduled_at")]
    jobs = actions(spark, folder).select(
        "id", "account_id", "entity_type", "action_type", "status", F.col("total_entities").cast("string").alias("total_entities"),
        "configuration", F.lit(1).alias("row_number"), *text,
    )
    counted = read(spark, folder, "lineitem").groupBy(F.concat(F.lit("a-"), "l_orderkey").alias("action_id")).agg(
        F.count(F.lit(1)).cast("string").alias("total_records")
    )
    counted = counted.join(jobs.select(F.col("id").alias("action_id")), "action_id", "left_semi")
    rest = [F.lit("-").alias(c) for c in ("successful_records", "failed_records", "skipped_records")]
    counters = counted.select("*", *rest, F.lit(1).alias("row_number"))
    seeds.load_all(spark, people.filter("row_number < 20"), jobs, counters.limit(0), path)
    loaded = seeds.load_all(spark, people, jobs, counters, path)
    return (
        loaded["contacts"].select(F.lit("contacts").alias("name"), "id", F.col("name").cast("bigint").alias("value"))
        .union(loaded["actions"].select(F.lit("actions"), "id", "total_entities"))
        .union(loaded["stats"].select(F.lit("stats"), "action_id", "total_records"))
    )


@query(
    "snapshot_table",
    "SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_type = 'ECONOMY'",
)
def snapshot_table(spark, folder):
    path = scratch_dir(spark, "part")
    tables.write_table(read(spark, folder, "part"), f"{path}/first", sort_by="p_partkey")
    changed = tables.read_table(spark, f"{path}/first").withColumn("p_size", F.col("p_size") + 1)
    tables.write_table(changed, f"{path}/second", sort_by="p_partkey")
    return tables.read_table(spark, f"{path}/second", {"p_type": "ECONOMY"}).select("p_partkey", "p_size")


_QUOTED = [f"""replace({cell.rsplit(' AS ', 1)[0]}, '"', '""')""" for cell in _CELLS]
_ROW_BYTES = " + ".join(f"strlen({cell}) + 3" for cell in _QUOTED)


@query(
    "scan_counters",
    f"""SELECT count(*) AS processed_rows, count(*) FILTER (c_custkey % 4 <> 0) AS valid_rows,
      count(*) FILTER (c_custkey % 4 = 0) AS invalid_rows, CAST(0 AS BIGINT) AS empty_rows,
      CAST(sum({_ROW_BYTES}) + count(DISTINCT c_nationkey) * strlen('"id","name","age"' || chr(10)) AS BIGINT) AS processed_bytes,
      TRUE AS is_whole, TRUE AS has_rates FROM customer""",
)
def scan_counters(spark, folder):
    """One file per nation; the rates depend on the clock, so only that there are some is compared."""
    path = scratch_dir(spark, "scan")
    rows = read(spark, folder, "customer").selectExpr("c_nationkey", "c_custkey", *_CELLS)
    arranged = rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey")
    delimited.write_partitioned(arranged, f"{path}/in", "c_nationkey")
    found = progress.measured_scan(spark, f"{path}/in", lambda df: df.withColumn("is_valid", F.col("name") != ""), f"{path}/out")
    return found.select(
        "processed_rows",
        "valid_rows",
        "invalid_rows",
        "empty_rows",
        "processed_bytes",
        (F.col("processed_bytes") == F.col("total_bytes")).alias("is_whole"),
        ((F.col("rows_per_second") > 0) & (F.col("bytes_per_second") > 0)).alias("has_rates"),
    )


_PLACED_LINE = "'c' || c_custkey || ',\"' || repeat('é', CAST(c_custkey % 5 AS INT)) || '\",日本' || c_nationkey"


@query(
    "csv_places",
    f"""WITH l AS (SELECT c_nationkey, c_custkey, {_PLACED_LINE} AS line FROM customer)
    SELECT row_number() OVER (ORDER BY 'n=' || c_nationkey || '/', c_custkey) AS row_number, 'c' || c_custkey AS id, line AS raw_line,
      CAST(strlen('id,note,place') + 2 + coalesce(sum(strlen(line) + 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM l""",
)
def csv_places(spark, folder):
    """Files with two-byte line ends and characters of several bytes."""
    path = scratch_dir(spark, "places")
    rows = read(spark, folder, "customer").selectExpr("c_nationkey AS n", "c_custkey", f"{_PLACED_LINE} AS line")
    headers = rows.select("n").distinct().select("n", F.lit(-1).cast("bigint").alias("c_custkey"), F.lit("id,note,place").alias("line"))
    arranged = rows.select("n", F.col("c_custkey").cast("bigint"), "line").unionByName(headers).repartition("n")
    arranged = arranged.sortWithinPartitions("n", "c_custkey").select("n", "line")
    arranged.write.option("lineSep", "\r\n").partitionBy("n").text(path)
    return delimited.read_delimited(spark, path, places=True).select("row_number", "id", "raw_line", "byte_offset")


@query(
    "ingest_progress",
    """WITH b AS (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS done, max(l_linenumber) AS last FROM lineitem GROUP BY 1),
    t AS (SELECT l_orderkey AS run_id, n AS processed_rows, done AS processed_bytes, 150 AS total_bytes, n * 20 AS elapsed_ms FROM b)
    SELECT run_id, round(least(100.0, processed_bytes / total_bytes::DOUBLE * 100), 6) AS percentage,
      CAST(ceil(total_bytes / (processed_bytes / processed_rows::DOUBLE)) AS BIGINT) AS estimated_total_rows,
      round((total_bytes - processed_bytes) / (processed_bytes / elapsed_ms::DOUBLE), 6) AS remaining_ms,
      round(processed_rows / elapsed_ms::DOUBLE * 1000, 6) AS rows_per_second FROM t""",
)
def ingest_progress(spark, folder):
    lines = read(spark, folder, "lineitem")
    # Running totals per run, as a job reports them batch by batch; a run has few batches.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    batches = lines.select(
        F.col("l_orderkey").alias("run_id"),
        F.row_number().over(order).alias("batch_id"),
        F.count(F.lit(1)).over(upto).alias("processed_rows"),
        F.sum("l_quantity").over(upto).cast("bigint").alias("processed_bytes"),
        F.lit(150).alias("total_bytes"),
        (F.count(F.lit(1)).over(upto) * 20).alias("elapsed_ms"),
    )
    report = progress.progress_report(progress.latest_progress(batches))
    rounded = {c: F.round(c, 6) for c in ("percentage", "remaining_ms", "rows_per_second")}
    return report.withColumns(rounded).select(
        "run_id", "percentage", "estimated_total_rows", "remaining_ms", "rows_per_second"
    )


@query(
    "csv_validated",
    """SELECT count(*) AS total_rows, count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AND c_nationkey > 0) AS valid_rows
    FROM customer""",
)
def csv_validated(spark, folder):
    rows = delimited.read_delimited(spark, _write_contacts(spark, folder, "csv"))
    mailed = rows.withColumn("email", F.concat("id", F.lit("@x.io")))
    return validate.validation_totals(validate.validate(mailed, keep=("row_number", "source_file"))).select(
        "total_rows", "valid_rows"
    )
