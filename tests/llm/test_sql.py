"""Queries of this package against their DuckDB SQL over whole tables."""

from __future__ import annotations

import pytest

from gatelens.llm import queries
from tests.compare import compare, connect


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, key):
    assert compare(queries.QUERIES[key](spark, sf_dir), connect(sf_dir), queries.SQL[key]) == []
