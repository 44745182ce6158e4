"""Every registered query against its DuckDB statement, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from emberlog.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    relation = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SPARK_TYPES[t] for c, t in df.dtypes} == types
    spark_rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    duck_rows = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert spark_rows == duck_rows


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["session_id", "last_ts", "event_count", "error_count", "last_ms"]
    assert 0 < df.count() <= 20
