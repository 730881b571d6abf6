"""Every registered query against its SQL on the smallest data set."""

import math
import os

import duckdb
import pytest

from rowmill.catalog import ORACLE, QUERIES

FOLDER = os.environ.get("ROWMILL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SPARK_TO_SQL = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, FOLDER).columns
        return
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(types) == columns
    assert {c: SPARK_TO_SQL.get(t) for c, t in df.dtypes} == types
    names = [d[0] for d in result.description]
    expected = sorted(
        (tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in result.fetchall()), key=repr
    )
    found = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert len(found) == len(expected)
    assert found == expected
