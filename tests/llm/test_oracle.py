"""Registered text queries against their SQL, on the whole given tables."""

from __future__ import annotations

import pytest

from caseloom.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(data):
    with connect(data) as c:
        yield c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, con, name):
    assert assert_same(QUERIES[name](spark, data), con, ORACLES[name]) > 0
