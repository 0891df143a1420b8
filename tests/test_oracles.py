"""Every query with SQL against DuckDB over the whole tables of one scale."""

from __future__ import annotations

import pytest

from gatelens.plans import registry
from tests.compare import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()
ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert ROWS_ONLY == []


@pytest.mark.parametrize("key", sorted(SQL))
def test_equals_sql(spark, sf_dir, key):
    assert compare(QUERIES[key](spark, sf_dir), connect(sf_dir), SQL[key]) == []


def test_flagship_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 1
