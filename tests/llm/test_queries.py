"""Registered queries with SQL against DuckDB; tables of no rows; the entry points."""

import os

import duckdb
import pytest

from rowmill.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("ROWMILL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(row[names.index(c)] for c in df.columns) for row in result.fetchall()), key=repr)
    found = sorted((tuple(r) for r in df.collect()), key=repr)
    assert len(found) == len(expected)
    assert found == expected


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for table in TABLES:
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    found = QUERIES[name](spark, empty_folder).collect()
    assert len(found) == (name == "op7_chat_format")
