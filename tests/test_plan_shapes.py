"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest

from gatelens.operators import stats
from gatelens.plans import fixtures, registry

BATCH = sorted(k for k in registry.queries() if not k.startswith("stream_") or "resolve" in k or "text" in k)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", BATCH)
def test_no_pairwise_joins(spark, sf_dir, key):
    text = plan(registry.queries()[key](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time functions


def test_price_lookup_is_broadcast(spark, sf_dir):
    text = plan(registry.queries()["request_cost"](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_recent_requests_are_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(stats.recent_requests(fixtures.request_logs(spark, sf_dir)))


def test_range_reaches_the_scan(spark, sf_dir):
    for key in ("daily_cost_series", "request_log_scan"):
        assert "GreaterThanOrEqual(ts," in plan(registry.queries()[key](spark, sf_dir))


def test_unused_columns_are_not_read(spark, sf_dir):
    text = plan(registry.queries()["model_distribution"](spark, sf_dir))
    assert "ReadSchema: struct<event_type:string>" in text


def test_sums_combine_before_the_shuffle(spark, sf_dir):
    text = plan(registry.queries()["stats_summary"](spark, sf_dir))
    assert text.count("partial_sum") >= 1
