"""Every query that has SQL is held against DuckDB; the others must run and give rows."""

import pytest

from tests.oracle import SF, compare
from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, con, name):
    assert compare(con, catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
