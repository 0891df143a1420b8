"""Pivot search against full search: the same rows, and how much of the index is left out."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatelens.operators import pivots, semantic
from tests.test_semantic import BASE, by_hand, frames, make


def clustered(rng, centres, n, dim, spread):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, dim))


@pytest.mark.parametrize("scope", ["tenant", "global"])
@pytest.mark.parametrize("timed", [True, False])
def test_equals_full_search(spark, monkeypatch, scope, timed):
    monkeypatch.setattr(semantic, "QUERIES_PER_GROUP", 50)
    index, queries = make(seed=3)
    i, q = frames(spark, index, queries, timed)
    want = by_hand(index, queries, 0.95, scope, timed)
    found = pivots.pivot_top1(q, i, 0.95, scope, rows_per_cell=9).collect()
    assert {r.query_id: r.seq for r in found} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.score - want[r.query_id][1]) < 1e-9 for r in found) and len(found) == len(want) > 0


@pytest.mark.parametrize("threshold", [0.2, 0.7, 0.95, 1.0])
def test_recall_is_one_at_any_threshold_and_with_any_pivots(spark, threshold):
    rng = np.random.default_rng(4)
    stored = np.round(clustered(rng, 12, 300, 6, 0.2), 3)
    asked = np.concatenate([stored[:40] * 3, stored[40:140] + rng.normal(scale=0.1, size=(100, 6)), -stored[:20]])
    index = [(i, "t", v.tolist(), BASE) for i, v in enumerate(stored)]
    queries = [(i, "t", v.tolist(), BASE) for i, v in enumerate(asked)]
    i, q = frames(spark, index, queries, False)
    limit = threshold - 1e-9 if threshold == 1 else threshold
    want = by_hand(index, queries, limit, "tenant")
    bad = np.array([[1.0, 0, 0, 0, 0, 0], [1.0, 1e-6, 0, 0, 0, 0]])
    for given in (None, bad / np.linalg.norm(bad, axis=1, keepdims=True)):
        celled = i if given is None else pivots.with_pivot(i, given)
        found = pivots.pivot_top1(q, celled, limit, pivots=given, rows_per_cell=15).collect()
        assert {r.query_id: r.seq for r in found} == {k: v[0] for k, v in want.items()}


def test_cells_visited(spark):
    """Of clustered vectors a query sees few cells, and one cell of copies is cut into blocks."""
    rng = np.random.default_rng(5)
    stored = np.concatenate([clustered(rng, 40, 1500, 24, 0.05), np.tile(rng.normal(size=24), (1500, 1))])
    index = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(stored)], "seq long, tenant string, vector array<double>")
    asked = stored[rng.integers(0, 3000, 200)]
    queries = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(asked)], "query_id long, tenant string, vector array<double>")
    p = pivots.choose_pivots(index, 30)
    assert len(p) == 100
    celled = pivots.with_pivot(index, p).withColumn("scope", F.lit("t"))
    rings = celled.groupBy("scope", "pivot").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count(F.lit(1)) / 30).cast("int").alias("blocks")
    )
    assert rings.agg(F.max("blocks")).first()[0] >= 50 / 2  # copies fall to one of the equal pivots
    seen = pivots.visits(semantic.asked(queries, F.lit("t"), False), p, rings, math.acos(0.95) + 1e-6)
    sizes = {r.pivot: r.n for r in celled.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(sizes[r.pivot] for r in seen.select("pivot").collect())
    outside = sum(sizes[r.pivot] for r in seen.filter(F.col("blocks") < 20).select("pivot").collect())
    assert rows < 0.6 * 200 * 3000 and outside < 0.1 * 200 * 1500
    found = pivots.pivot_top1(queries, index, rows_per_cell=30)
    full = semantic.semantic_top1(queries, index)
    assert sorted(map(tuple, found.select("query_id", "seq").collect())) == sorted(map(tuple, full.select("query_id", "seq").collect()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    index = [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [inf, 0.0]), (7, [0.0, 0.0]), (8, [0.0])]
    asked = [(0, [1.0, 0.01]), (1, [nan, 0.0]), (2, [2.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0])]
    make_df = lambda rows, key: spark.createDataFrame([(i, "t", v) for i, v in rows], f"{key} long, tenant string, vector array<double>")
    q, v = make_df(asked, "query_id"), make_df(index, "seq")
    for cell in (1, 100):
        assert {(r.query_id, r.seq) for r in pivots.pivot_top1(q, v, 0.95, rows_per_cell=cell).collect()} == {(0, 0), (2, 2)}
    assert pivots.pivot_top1(q, v.limit(0)).collect() == [] and pivots.pivot_top1(q.limit(0), v).collect() == []
    with pytest.raises(ValueError):
        pivots.pivot_top1(q, v, 0.0)


def test_a_query_is_sent_once_to_a_part(spark):
    """Where bounds leave out little, a query is copied per part of the index and not per cell."""
    rng = np.random.default_rng(6)
    stored = np.abs(rng.normal(size=(300, 24))) + 1
    index = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(stored)], "seq long, tenant string, vector array<double>")
    queries = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(stored[:50] + 0.1)], "query_id long, tenant string, vector array<double>")
    p = pivots.choose_pivots(index, 2)
    rings = pivots.with_pivot(index, p).withColumn("scope", F.lit("t")).groupBy("scope", "pivot").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.lit(1).alias("blocks")
    )
    parts = pivots.parts_of(p, np.full(len(p), 2), 100)
    assert len(p) == 150 and set(parts) <= {0, 1, 2}
    asked = semantic.asked(queries, F.lit("t"), False)
    cells = pivots.visits(asked, p, rings, math.acos(0.9)).count()
    sent = pivots.visits(asked, p, rings, math.acos(0.9), parts)
    assert cells > 1000 and sent.count() <= 50 * 3 and sent.select("query_id", "part").distinct().count() == sent.count()
    again = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(stored[:40])], "query_id long, tenant string, vector array<double>")
    found = pivots.pivot_top1(again, index, rows_per_cell=2).collect()
    assert {(r.query_id, r.seq) for r in found} == {(i, i) for i in range(40)}


@pytest.mark.parametrize("pivot", [False, True])
def test_a_full_cell_is_searched_in_little_memory(pivot):
    rng = np.random.default_rng(7)
    table = lambda n, **more: pa.table({"vector": pa.array(list(rng.normal(size=(n, 8)))), **more})
    left = table(6000, query_id=np.arange(6000), at=np.zeros(6000, int), nearest=np.zeros(6000))
    right = table(2000, seq=np.arange(2000), since=np.full(2000, -1), until=np.full(2000, 1), pivot=np.zeros(2000, np.int32), angle=np.zeros(2000))
    tracemalloc.start()
    if pivot:
        pivots._best_in_part(left, right, np.eye(8)[:1], 0.5, 7.0)
    else:
        semantic._best_in_cell(left, right, 0.5)
    assert tracemalloc.get_traced_memory()[1] < 25e6
    tracemalloc.stop()
