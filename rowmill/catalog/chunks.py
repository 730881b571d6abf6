"""Queries: hash-range chunks and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.catalog.inputs import CONTACTS_SQL, contacts
from rowmill.catalog.registry import query, read
from rowmill.functions import ring
from rowmill.operators import chunking, dedup

SPACE = 2**64 - 1


def _h64(c: str) -> str:
    return f"CAST(CAST(('0x' || substr(sha256({c}), 1, 16)) AS UBIGINT) AS HUGEINT)"


def _index_sql(c: str, n: int) -> str:
    return f"CAST(least({_h64(c)} // CAST({SPACE // n} AS HUGEINT), {n - 1}) AS INTEGER)"


def _hex_sql(x: str) -> str:
    return f"lpad(lower(to_hex(CAST({x} AS UBIGINT))), 16, '0')"


def _start_sql(i: str, n: int) -> str:
    return _hex_sql(f"CAST({i} AS HUGEINT) * CAST({SPACE // n} AS HUGEINT)")


def _end_sql(i: str, n: int) -> str:
    return _hex_sql(
        f"CASE WHEN {i} = {n - 1} THEN CAST({SPACE} AS HUGEINT) "
        f"ELSE (CAST({i} AS HUGEINT) + 1) * CAST({SPACE // n} AS HUGEINT) - 1 END"
    )


N = 37
ROWS_SQL = f"""{CONTACTS_SQL}, kept AS (SELECT row_number, id, email, name,
    {_index_sql("lower(id)", N)} AS chunk_index FROM contacts WHERE id <> '')"""


def _assigned(spark, folder, naming="sequential"):
    rows = contacts(spark, folder).select("row_number", "id", "email", "name")
    options = chunking.ChunkOptions(chunks=N, naming=naming)
    return chunking.assign_chunks(rows, options), options


@query(
    "chunk_assign",
    f"""SELECT o_orderkey, {_index_sql("'o-' || o_orderkey", 100)} AS chunk_index FROM orders""",
)
def chunk_assign(spark, folder):
    rows = read(spark, folder, "orders").select("o_orderkey", F.concat(F.lit(" O-"), F.col("o_orderkey")).alias("id"))
    assigned = chunking.assign_chunks(rows, chunking.ChunkOptions(chunks=100))
    return assigned.select("o_orderkey", "chunk_index")


@query(
    "chunk_assign_kept",
    f"""WITH {CONTACTS_SQL}, k AS (SELECT *, lower(trim(email)) AS k FROM contacts),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_number) AS n FROM k)
    SELECT row_number, CASE WHEN id <> '' THEN {_index_sql("lower(id)", N)} END AS chunk_index FROM r WHERE k = '' OR n = 1""",
)
def chunk_assign_kept(spark, folder):
    rows = contacts(spark, folder).select("row_number", "id", "email")
    marked = dedup.mark_duplicates(rows, dedup.normalize_key(F.col("email")))
    return chunking.assign_chunks(marked, chunking.ChunkOptions(chunks=N)).select("row_number", "chunk_index")


@query("chunk_unassigned", f"WITH {CONTACTS_SQL} SELECT row_number FROM contacts WHERE id = ''")
def chunk_unassigned(spark, folder):
    return chunking.unassigned_rows(_assigned(spark, folder)[0]).select("row_number")


_PLAN = """WITH g AS (SELECT l_suppkey, count(*) * 9 AS n FROM lineitem GROUP BY l_suppkey),
    p AS (SELECT l_suppkey, n, greatest(1, CAST(ceil(n / 1000.0) AS BIGINT)) AS chunks FROM g)"""


@query(
    "chunk_plan",
    f"""{_PLAN} SELECT l_suppkey, CAST(n AS BIGINT) AS row_count, CAST(chunks AS INTEGER) AS chunks,
      CAST(ceil(n / CAST(chunks AS DOUBLE)) AS BIGINT) AS max_rows,
      CAST(floor(ceil(n / CAST(chunks AS DOUBLE)) * 0.1) AS BIGINT) AS min_rows FROM p""",
)
def chunk_plan(spark, folder):
    counts = read(spark, folder, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) * 9).alias("row_count"))
    return counts.withColumns(chunking.plan_chunks(F.col("row_count"), target=1000))


@query(
    "chunk_many_runs",
    f"""WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
    p AS (SELECT l_suppkey, greatest(1, CAST(ceil(n / 50.0) AS BIGINT)) AS chunks FROM g),
    i AS (SELECT l.l_suppkey, CAST(least({_h64("CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber")}
       // (CAST({SPACE} AS HUGEINT) // chunks), chunks - 1) AS INTEGER) AS chunk_index
       FROM lineitem l JOIN p ON l.l_suppkey = p.l_suppkey)
    SELECT l_suppkey, chunk_index, count(*) AS records FROM i GROUP BY 1, 2""",
)
def chunk_many_runs(spark, folder):
    lines = read(spark, folder, "lineitem").select(
        "l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")
    )
    plans = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    plans = plans.select("l_suppkey", chunking.plan_chunks(F.col("n"), target=50)["chunks"].alias("chunks"))
    joined = lines.join(plans, "l_suppkey")
    assigned = chunking.assign_chunks(joined, chunking.ChunkOptions(chunks=1), F.col("chunks"))
    return assigned.groupBy("l_suppkey", "chunk_index").agg(F.count(F.lit(1)).alias("records"))


@query(
    "chunk_ranges",
    f"""SELECT p_partkey, CAST(p_partkey % 100 AS INTEGER) AS i, {_hex_sql(
        f"CAST(p_partkey % 100 AS HUGEINT) * (CAST({SPACE} AS HUGEINT) // (p_partkey % 100 + 1 + p_size))")} AS range_start,
      {_hex_sql(f'''CASE WHEN p_size = 0 THEN CAST({SPACE} AS HUGEINT) ELSE (CAST(p_partkey % 100 AS HUGEINT) + 1)
        * (CAST({SPACE} AS HUGEINT) // (p_partkey % 100 + 1 + p_size)) - 1 END''')} AS range_end FROM part""",
)
def chunk_ranges(spark, folder):
    i = (F.col("p_partkey") % 100).cast("int")
    n = i + 1 + F.col("p_size")
    return read(spark, folder, "part").select(
        "p_partkey",
        i.alias("i"),
        ring.range_start(i, n).alias("range_start"),
        ring.range_end(i, n).alias("range_end"),
    )


META_SQL = f"""{ROWS_SQL}, meta AS (SELECT chunk_index, count(*) AS record_count, min(row_number) AS start_record,
    max(row_number) AS end_record,
    CAST(sum(length(id) + length(email) + length(name) + 2 + 5 + 4 + 3 + 10) AS BIGINT) AS estimated_size,
    {_start_sql('chunk_index', N)} AS hash_range_start, {_end_sql('chunk_index', N)} AS hash_range_end
    FROM kept GROUP BY chunk_index)"""


@query(
    "chunk_meta",
    f"""WITH {META_SQL} SELECT *, 'chunk-' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') || '-' ||
      substr(md5(chunk_index || '-run-id'), 1, 8) AS chunk_id,
      'chunk_' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') || '_' || hash_range_start || '-' || hash_range_end || '.csv' AS file_name,
      'completed' AS status FROM meta""",
)
def chunk_meta(spark, folder):
    assigned, options = _assigned(spark, folder, "hybrid")
    return chunking.chunk_metadata(assigned, options)


def _distribution(spark, folder):
    assigned, options = _assigned(spark, folder)
    return chunking.chunk_distribution(chunking.chunk_metadata(assigned, options))


_DIST = """SELECT CAST(sum(record_count) AS BIGINT) AS total_hashes, count(*) AS chunks, avg(record_count) AS average_records,
    min(record_count) AS min_records, max(record_count) AS max_records,
    stddev_pop(record_count) AS standard_deviation FROM meta"""


@query(
    "chunk_distribution",
    f"""WITH {META_SQL}, d AS ({_DIST}) SELECT total_hashes, chunks, round(average_records, 6) AS average_records,
      min_records, max_records, round(standard_deviation, 6) AS standard_deviation FROM d""",
)
def chunk_distribution(spark, folder):
    return _distribution(spark, folder).withColumns(
        {"average_records": F.round("average_records", 6), "standard_deviation": F.round("standard_deviation", 6)}
    )


@query(
    "chunk_shares",
    f"""WITH {META_SQL} SELECT chunk_index, hash_range_start, hash_range_end, record_count,
      round(record_count / CAST(sum(record_count) OVER () AS DOUBLE) * 100, 6) AS percentage FROM meta""",
)
def chunk_shares(spark, folder):
    assigned, options = _assigned(spark, folder)
    shares = chunking.chunk_shares(chunking.chunk_metadata(assigned, options))
    return shares.withColumn("percentage", F.round("percentage", 6))


@query(
    "chunk_balance",
    f"""WITH {META_SQL}, d AS ({_DIST}), v AS (SELECT *, standard_deviation / average_records > 0.3 AS a,
      min_records / CAST(max_records AS DOUBLE) < 0.5 AS c FROM d)
    SELECT NOT a AND NOT c AS is_balanced,
      concat_ws(';', CASE WHEN a THEN 'High variation in chunk sizes' END,
        CASE WHEN c THEN 'Significant imbalance between smallest and largest chunks' END) AS issues,
      concat_ws(';', CASE WHEN a THEN 'Consider increasing the number of chunks or using a different hash field' END,
        CASE WHEN c THEN 'Consider using more chunks or different hash distribution' END) AS recommendations FROM v""",
)
def chunk_balance(spark, folder):
    verdict = chunking.chunk_balance(_distribution(spark, folder))
    return verdict.select(
        "is_balanced",
        F.array_join("issues", ";").alias("issues"),
        F.array_join("recommendations", ";").alias("recommendations"),
    )


_PART = "CAST(CAST(('0x' || substr(hash_range_start, 1, 8)) AS UBIGINT) % 5 AS INTEGER)"


@query(
    "chunk_partition",
    f"""WITH {META_SQL}, c AS (SELECT {_PART} AS partition_id, count(*) AS chunks FROM meta GROUP BY 1)
    SELECT CAST(p AS INTEGER) AS partition_id, coalesce(chunks, 0) AS chunks FROM range(5) r(p)
      LEFT JOIN c ON c.partition_id = p""",
)
def chunk_partition(spark, folder):
    assigned, options = _assigned(spark, folder)
    return chunking.partition_distribution(chunking.chunk_metadata(assigned, options))


@query(
    "chunk_jobs",
    f"""WITH {META_SQL} SELECT {_PART} AS partition_id, count(*) AS jobs, CAST(sum(record_count) AS BIGINT) AS records,
      string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS chunk_indexes FROM meta GROUP BY 1""",
)
def chunk_jobs(spark, folder):
    assigned, options = _assigned(spark, folder)
    jobs = chunking.partition_jobs(chunking.chunk_metadata(assigned, options))
    listed = chunking.partition_lists(jobs)
    return listed.withColumn("chunk_indexes", F.array_join(F.col("chunk_indexes").cast("array<string>"), ","))


@query("chunk_job_rows", f"WITH {META_SQL} SELECT {_PART} AS partition_id, chunk_index, record_count FROM meta")
def chunk_job_rows(spark, folder):
    assigned, options = _assigned(spark, folder)
    return chunking.partition_jobs(chunking.chunk_metadata(assigned, options))


@query(
    "chunk_job_totals",
    f"""WITH {META_SQL} SELECT {_PART} AS partition_id, count(*) AS jobs, CAST(sum(record_count) AS BIGINT) AS records
      FROM meta GROUP BY 1""",
)
def chunk_job_totals(spark, folder):
    assigned, options = _assigned(spark, folder)
    return chunking.partition_totals(chunking.partition_jobs(chunking.chunk_metadata(assigned, options)))


@query(
    "batch_assign",
    """SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS batch, count(*) AS records FROM orders GROUP BY 1""",
)
def batch_assign(spark, folder):
    batch = chunking.batch_number(F.col("o_orderkey") + 1)
    return read(spark, folder, "orders").groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "chunk_names",
    """SELECT o_orderkey, 'chunk_' || lpad(CAST(o_orderkey % 2000 AS VARCHAR), CASE WHEN o_orderkey % 2000 > 999 THEN 4 ELSE 3 END, '0')
      || '.csv' AS sequential, 'chunk_00ff-1fff.csv' AS by_range FROM orders""",
)
def chunk_names(spark, folder):
    index = F.col("o_orderkey") % 2000
    start, end = F.lit("00ff"), F.lit("1fff")
    return read(spark, folder, "orders").select(
        "o_orderkey",
        chunking.chunk_file_name(index, start, end).alias("sequential"),
        chunking.chunk_file_name(index, start, end, "hash_range").alias("by_range"),
    )
