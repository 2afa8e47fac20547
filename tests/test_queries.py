"""Every registered query against its SQL, on the smallest given tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(columns, records):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in order)) for r in records)


def test_every_query_has_sql():
    assert set(entry_point.QUERIES) == set(entry_point.ORACLES)


@pytest.mark.parametrize("name", sorted(entry_point.QUERIES))
def test_query(spark, sf, duck, name):
    result = entry_point.queries()[name](spark, sf)
    expected = duck.sql(entry_point.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert rows(result.columns, result.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
