"""The corpus operators that have SQL against DuckDB on the smallest tables."""

import pytest

from graphlens.llm import queries
from tests.oracle import SMALL, compare

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0
