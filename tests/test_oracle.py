"""Every registered query against DuckDB on the same files."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, difference
from workload.registry import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert all(query.sql for query in QUERIES.values())
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert difference(entry.queries()[name](spark, SF_DIR), connection, entry.oracle_sql()[name]) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["group", "value", "percentage_change"]
    assert result.count() > 0
