"""Vector search against a full NumPy product, with small cells to force slicing."""

from __future__ import annotations

import datetime
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatelens.operators import cache, embed, routing, semantic
from gatelens.plans import samples

BASE = datetime.datetime(2024, 3, 1)


def make(seed=1, n_index=240, n_queries=300, dim=8):
    rng = np.random.default_rng(seed)
    stored = rng.normal(size=(n_index, dim))
    stored[5] = stored[9] * 2  # same direction: a tie, won by the older entry
    stored[7] = 0
    asked = stored[rng.integers(0, n_index, n_queries)] + rng.normal(scale=0.12, size=(n_queries, dim))
    asked[3], asked[4] = stored[9], 0
    # Two thirds of everything belong to one tenant.
    tenant = lambda i: "hot" if i % 3 else f"t{i % 4}"
    index = [(i, tenant(i), v.tolist(), BASE + datetime.timedelta(seconds=i)) for i, v in enumerate(stored)]
    queries = [(i, tenant(i), v.tolist(), BASE + datetime.timedelta(seconds=120)) for i, v in enumerate(asked)]
    return index, queries


def by_hand(index, queries, threshold, scope, alive=False):
    def unit(v):
        v = np.array(v)
        return v / (np.linalg.norm(v) or 1)

    out = {}
    for q, tenant, vector, arrival in queries:
        best = None
        for seq, owner, stored, expires in index:
            if scope == "tenant" and owner != tenant or alive and expires <= arrival:
                continue
            score = float(unit(vector) @ unit(stored))
            if best is None or score > best[1] + 1e-12:
                best = (seq, score)
        if best and best[1] >= threshold:
            out[q] = best
    return out


def frames(spark, index, queries, timed):
    i = spark.createDataFrame(index, "seq long, tenant string, vector array<double>, expires_at timestamp_ntz")
    q = spark.createDataFrame(queries, "query_id long, tenant string, vector array<double>, arrival timestamp_ntz")
    return (i, q) if timed else (i.drop("expires_at"), q.drop("arrival"))


@pytest.mark.parametrize("scope", ["tenant", "global"])
@pytest.mark.parametrize("one_block", [True, False])
@pytest.mark.parametrize("timed", [True, False])
def test_equals_full_search(spark, monkeypatch, scope, one_block, timed):
    monkeypatch.setattr(semantic, "QUERIES_PER_GROUP", 50)
    monkeypatch.setattr(semantic, "_SCORES_PER_STEP", 1000)
    if not one_block:
        monkeypatch.setattr(semantic, "INDEX_PER_BLOCK", 30)
    index, queries = make()
    i, q = frames(spark, index, queries, timed)
    found = semantic.semantic_top1(q, i, 0.95, scope).collect()
    want = by_hand(index, queries, 0.95, scope, timed)
    assert {r.query_id: r.seq for r in found} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.score - want[r.query_id][1]) < 1e-9 for r in found)
    assert len(found) == len(want) > 0


def test_index_beyond_any_cache_bound(spark):
    """The only matches are the oldest of 12,000 entries."""
    rng = np.random.default_rng(8)
    stored = rng.normal(size=(12_000, 8))
    index = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(stored)], "seq long, tenant string, vector array<double>")
    queries = spark.createDataFrame([(i, "t", stored[i].tolist()) for i in range(3)], "query_id long, tenant string, vector array<double>")
    found = semantic.semantic_top1(queries, index, 0.9999).collect()
    assert {(r.query_id, r.seq) for r in found} == {(0, 0), (1, 1), (2, 2)}


def test_vectors_that_match_nothing(spark):
    nan, inf = float("nan"), float("inf")
    index = [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [inf, 0.0]), (7, [None, 1.0])]
    asked = [(0, [1.0, 0.01]), (1, [nan, 0.0]), (2, [2.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [])]
    make_df = lambda rows, key: spark.createDataFrame([(i, "t", v) for i, v in rows], f"{key} long, tenant string, vector array<double>")
    found = semantic.semantic_top1(make_df(asked, "query_id"), make_df(index, "seq"), 0.95).collect()
    assert {(r.query_id, r.seq) for r in found} == {(0, 0), (2, 2)}


def test_no_answer_before_its_write(spark):
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    index = spark.createDataFrame([(0, "t", [1.0, 0.0], at(10), at(20))], "seq long, tenant string, vector array<double>, stored_at timestamp_ntz, expires_at timestamp_ntz")
    asked = spark.createDataFrame([(s, "t", [1.0, 0.0], at(s)) for s in (9, 10, 19, 20)], "query_id long, tenant string, vector array<double>, arrival timestamp_ntz")
    assert {r.query_id for r in semantic.semantic_top1(asked, index).collect()} == {10, 19}
    entries = spark.createDataFrame([("h", "a", at(10), at(20))], "prompt_hash string, response string, stored_at timestamp_ntz, expires_at timestamp_ntz")
    requests = spark.createDataFrame([("h", at(s), s) for s in (9, 10, 19, 20)], "prompt_hash string, arrival timestamp_ntz, i int")
    assert {r.i for r in cache.exact_lookup(requests, entries).collect() if r.response} == {10, 19}


def test_bound_over_many_buckets(spark):
    rows = [(i * 3_000, "hot" if i % 3 else "t") for i in range(200)] + [(7, "one")]
    df = spark.createDataFrame(rows, "seq long, tenant string")
    for n in (1, 5, 50, 1000):
        want = sorted((s for s, _ in rows), reverse=True)[:n]
        assert sorted((r.seq for r in cache.fifo_bound(df, n).collect()), reverse=True) == want
        kept = {(r.seq, r.tenant) for r in cache.fifo_bound(df, n, by="tenant").collect()}
        assert kept == {(s, t) for t in ("hot", "t", "one") for s in sorted((s for s, u in rows if u == t), reverse=True)[:n]}


def test_entries_without_order_are_the_oldest(spark):
    rows = [(i, "a") for i in range(15)] + [(None, "a")] * 5 + [(None, None)] * 3 + [(70, None)]
    df = spark.createDataFrame(rows, "seq long, tenant string")
    count = lambda n, by=None: sorted((r.seq if r.seq is not None else -1, r.tenant or "") for r in cache.fifo_bound(df, n, by).collect())
    assert len(count(100)) == len(rows) and len(count(18)) == 18 and sum(s < 0 for s, _ in count(18)) == 2
    assert count(17, "tenant")[:5] == [(-1, ""), (-1, ""), (-1, ""), (-1, "a"), (-1, "a")] and len(count(17, "tenant")) == 21
    only = spark.createDataFrame([(None, f"{i:04x}") for i in range(30)], "last_access timestamp_ntz, prompt_hash string")
    assert sorted(r.prompt_hash for r in cache.lru_bound(only, 7).collect()) == [f"{i:04x}" for i in range(7)]


def test_a_bulk_load_at_one_instant_is_split(spark):
    at = lambda s: BASE + datetime.timedelta(microseconds=s)
    rows = [(at(0), f"{i * 7919 % 65536:04x}", "t") for i in range(3000)] + [(at(i), f"x{i}", "t") for i in range(1, 6)] + [(at(90_000_000), "new", "u")]
    df = spark.createDataFrame(rows, "last_access timestamp_ntz, prompt_hash string, tenant string")
    want = ["new", "x5", "x4", "x3", "x2", "x1", *sorted(h for t, h, _ in rows if t == at(0))]
    for n in (1, 4, 6, 500, 9000):
        assert sorted(r.prompt_hash for r in cache.lru_bound(df, n).collect()) == sorted(want[:n])
    per = {r.prompt_hash for r in cache.lru_bound(df, 8, by="tenant").collect()}
    assert per == {"new", *want[1:9]}


def test_bound_keeps_the_newest(spark):
    index, _ = make()
    i = spark.createDataFrame([(s, t) for s, t, _, _ in index], "seq long, tenant string")
    kept = {r.seq for r in cache.fifo_bound(i, 3, by="tenant").collect()}
    want = set()
    for tenant in {t for _, t, _, _ in index}:
        want |= set(sorted((s for s, t, _, _ in index if t == tenant), reverse=True)[:3])
    assert kept == want
    assert {r.seq for r in cache.fifo_bound(i, 2).collect()} == {239, 238}


def test_default_embedding(spark):
    rows = [(0, "Audit this contract"), (1, "audit THIS contract"), (2, "something else"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "i long, text string")
    vectors = {r.i: np.array(r.vector) for r in embed.embed(df).collect()}
    assert all(len(v) == 384 for v in vectors.values())
    assert np.allclose(vectors[0], vectors[1]) and not np.allclose(vectors[0], vectors[2])
    assert abs(np.linalg.norm(vectors[0]) - 1) < 1e-6
    assert not vectors[3].any() and not vectors[4].any()


def test_supplied_encoder(spark):
    df = spark.createDataFrame([(0, "abc"), (1, None)], "i long, text string")
    factory = lambda: lambda texts: [[len(t), 1.0] for t in texts]
    found = {r.i: list(r.vector) for r in embed.embed(df, encoder=factory).collect()}
    assert found == {0: [3.0, 1.0], 1: [0.0, 1.0]}


def test_routing_embeds_only_open_scores(spark):
    df = spark.createDataFrame(list(enumerate(samples.ROUTING)), "i long, text string")
    rows = {r.i: r for r in routing.route_prompts(df).collect()}
    assert len(rows) == len(samples.ROUTING)
    for r in rows.values():
        assert (r.label is not None) == (-1 < r.score < 6)
        if r.score >= 6 or r.label == "complex":
            assert (r.target_model, r.strategy) == ("gpt-4o", "intensive_reasoning")
        else:
            assert (r.target_model, r.strategy) == ("gpt-3.5-turbo", "efficiency_optimized")


def test_explicit_model_is_kept_on_request(spark):
    df = spark.createDataFrame(
        [(9, None, "auto"), (9, None, "my-model"), (4, None, None), (1, None, "auto")],
        "score int, label string, model string",
    )
    kept = [r.target_model for r in routing.decide_route(df, respect_explicit=True).collect()]
    assert kept == ["gpt-4o", "my-model", "gpt-4o", "gpt-3.5-turbo"]


def test_vectors_of_floats_travel_as_floats(spark):
    def side(kind):
        return spark.range(3).selectExpr("id AS query_id", "id AS seq", "'t' AS tenant", f"CAST(array(id + 1, 0.1, 2) AS array<{kind}>) AS vector")

    for kind, travels in (("float", "float"), ("double", "double"), ("int", "double"), ("decimal(20,3)", "double")):
        by = F.lit("*")
        for moved in (semantic.asked(side(kind), by, False), semantic.stored(side(kind), by, False)):
            assert moved.schema["vector"].dataType.elementType.simpleString() == travels
    # Floats against doubles: both are computed with as doubles.
    wide = side("float").withColumn("vector", F.col("vector").cast("array<double>"))
    same = [sorted(map(tuple, semantic.semantic_top1(q, v, 0.5).collect())) for q in (side("float"), wide) for v in (side("float"), wide)]
    assert len(same[0]) == 3 and all(s == same[0] for s in same)


def test_unit_vectors_hold_one_copy():
    rng = np.random.default_rng(3)
    for kind in (np.float32, np.float64):
        rows = rng.normal(size=(5000, 200)).astype(kind)
        rows[7] = 0
        flat = pa.array(rows.ravel())
        column = pa.chunked_array([pa.ListArray.from_arrays(np.arange(0, rows.size + 1, 200, dtype=np.int32), flat)])
        tracemalloc.start()
        unit = semantic.unit_matrix(column)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1.5 * unit.nbytes
        lengths = np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
        assert unit.dtype == float and np.array_equal(unit, rows.astype(float) / np.where(lengths > 0, lengths, 1))
