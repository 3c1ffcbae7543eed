"""Every registered query against its SQL counterpart."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from respondex.plans.oracle import ORACLE
from respondex.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = ("conversations", "embeddings", "documents", "benchmark")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in rows)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry_point.queries().keys()
    assert ORACLE.keys() <= entry_point.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    found = QUERIES[name](spark, str(DATA))
    result = database.sql(ORACLE[name])
    want = rows_by_name(result.columns, result.fetchall())
    assert rows_by_name(found.columns, [tuple(r) for r in found.collect()]) == want


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["result_distance"] == 0.0
