import pytest
from compare import difference

from furrow.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    assert difference(frame, duck, ORACLES[name]) is None
    assert frame.count() > 0
