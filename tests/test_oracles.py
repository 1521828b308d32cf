"""Every bound query with SQL must agree with it on the smallest tables."""

import pytest
from compare import difference

from furrow.bindings import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf), duck, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
