"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, open_tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    status, _, _ = compare(spark, SF_DIR, tables, name)
    assert status == "match"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
