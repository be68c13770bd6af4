"""Each query that SQL can express against DuckDB on the same tables."""

import pytest

from fluxtrace.llm.oracles import ORACLES
from fluxtrace.llm.queries import QUERIES
from tests.compare import assert_same, connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    if name not in QUERIES:
        pytest.skip("the pipeline has its own test")
    assert_same(QUERIES[name](spark, data).toPandas(), connection(data).execute(ORACLES[name]).df())
