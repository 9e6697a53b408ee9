"""Every query with an SQL text equals it; the others return rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, sf, con, key):
    assert compare(spark, QUERIES[key], ORACLES[key], sf, con) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf, key):
    assert QUERIES[key](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
