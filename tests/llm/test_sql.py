"""Queries that SQL can express are held against DuckDB."""

import pytest

from tests.oracle import SF, compare
from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_duckdb(spark, con, name):
    assert compare(con, registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name]) == ""
