"""Every registered query against its SQL, on the whole given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import assert_same, connect

# Text queries are checked beside their operators.
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.TEXT_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k not in entry.TEXT_ORACLES}
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def con(data):
    with connect(data) as c:
        yield c


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, con, name):
    assert assert_same(QUERIES[name](spark, data), con, ORACLES[name]) > 0


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["age_group", "sex", "outcome", "count", "percent", "share"]
    assert df.count() > 0
