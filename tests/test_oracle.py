"""Registered queries against their DuckDB statements on the smallest tables."""

import os

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# Needs 20 lab items; the smallest tables have 10 suppliers.
LARGER_ONLY = {"ml11_multimodal_table"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LARGER_ONLY))
def test_query_equals_statement(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_statement_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
