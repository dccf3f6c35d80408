"""Every registered query against its SQL, on whole tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import entry, oracle_sql, queries

from catalog.oracle import ORACLE
from catalog.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ["events", "conversations", "orders", "customer", "lineitem"]:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def in_order(rows):
    return sorted(rows, key=repr)


# Spark's types as DuckDB names them.
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    rows = [tuple(r) for r in result.select(*columns).collect()]
    assert rows
    expected = duck.sql(oracle_sql()[name])
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert types == {f.name: TYPES[f.dataType.simpleString()] for f in result.schema}
    assert in_order(rows) == in_order(expected.select(*columns).fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
