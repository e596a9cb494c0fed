"""Every registered query against its SQL text on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import base_tables
from oracle.check import compare, connect

QUERIES = {**base_tables.QUERIES, **entry.queries()}
SQL = {**base_tables.SQL, **entry.oracle_sql()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert compare(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
