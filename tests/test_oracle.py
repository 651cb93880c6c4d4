"""Every query against its SQL twin in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def folder():
    """Larger than the other tests' data: its series are long enough for a hold-out."""
    return os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    result = QUERIES[name](spark, folder)
    rows = result.collect()
    assert rows
    if name in ORACLE:
        expected = duck.sql(ORACLE[name])
        assert sorted(result.columns) == sorted(expected.columns)
        assert _sorted(rows, result.columns) == _sorted(expected.fetchall(), expected.columns)


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.count() == 150
    assert result.columns[0] == "CustomerID" and len(result.columns) == 17
