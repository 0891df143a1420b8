"""Hierarchies, walks and whole queries against plain assignment of every vector."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from gatelens.llm import anchors, queries


def brute(rows):
    """(vec_id -> (code, error, label), codebook digest) of (vec_id, vector, label) rows by plain Python."""
    rows = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return [], None
    width = len(rows[0][1]) // 8
    least = {}
    for i, v, _ in rows:
        least[i] = min(v, least.get(i, v))
    first = [least[i] for i in sorted(least, key=lambda i: (i is None, i or 0))[:16]]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(8):
        cut = slice(p * width, (p + 1) * width)
        book = [v[cut] for v in first]
        near = lambda part: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(6):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(v[cut])[1], []).append(v[cut])
            for k, own in groups.items():
                book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for r, (_, v, _) in enumerate(rows):
            far, k = near(v[cut])
            codes[r].append(f"{k:02x}")
            errors[r] += far
        books += [x for e in book for x in e]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return [(i, "".join(c), e, label) for (i, _, label), c, e in zip(rows, codes, errors, strict=True)], digest


def with_label_errors(found):
    totals = {}
    for _, _, error, label in found:
        totals[label] = totals.get(label, 0) + error
    return [(i, code, error, totals[label]) for i, code, error, label in found]


def test_balls_hold_their_points():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-900, 900, (700, 6)), rng.integers(0, 3, (600, 6)), np.full((300, 6), 7)])
    order, balls = anchors.hierarchy(points)
    sorted_points = points[order]
    assert sorted(order.tolist()) == list(range(len(points)))
    wide = anchors.radii(sorted_points.astype(float), balls)
    for (first, stop, left, right, *total), radius in zip(balls.tolist(), wide, strict=True):
        own = sorted_points[first:stop]
        assert own.sum(axis=0).tolist() == total
        assert np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1)).max() <= radius
        assert (left == 0) == (right == 0)
        if left:
            assert balls[left, 0] == first and balls[left, 1] == balls[right, 0] and balls[right, 1] == stop
    assert tuple(balls[0, :2]) == (0, len(points))


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "equal", "large"])
def test_walks_equal_plain_assignment(kind):
    rng = np.random.default_rng(6)
    n = 1500
    points = {
        "spread": rng.integers(-4000, 4000, (n, 8)),
        "clustered": rng.integers(-4000, 4000, (12, 8))[rng.integers(0, 12, n)] + rng.integers(-9, 9, (n, 8)),
        "ties": rng.integers(0, 2, (n, 8)),
        "equal": np.full((n, 8), -3),
        "large": rng.integers(-anchors.LARGEST, anchors.LARGEST, (n, 8)),
    }[kind]
    entries = np.concatenate([points[:12], points[3:5], points[100:101] + 2, points[:1]])
    order, balls = anchors.hierarchy(points)
    own = points[order].astype(np.int32)
    wide = anchors.radii(own.astype(float), balls)
    near = anchors.squares(own, entries).argmin(axis=1)
    assert (anchors.codes_of(own, balls, wide, entries) == near).all()
    sums, counts = anchors.sums_of(own, balls, wide, entries)
    assert counts.tolist() == np.bincount(near, minlength=len(entries)).tolist()
    assert all((sums[e] == points[order][near == e].sum(axis=0)).all() for e in range(len(entries)))


def test_tight_balls_are_owned_whole():
    rng = np.random.default_rng(7)
    centres = rng.integers(-30000, 30000, (8, 8))
    points = centres[rng.integers(0, 8, 2048)] + rng.integers(-20, 20, (2048, 8))
    order, balls = anchors.hierarchy(points)
    own = points[order].astype(np.int32)
    _, runs, _, places = anchors.owned(own, balls, anchors.radii(own.astype(float), balls), centres)
    assert len(places) == 0 and len(runs) < 64


def query(spark, tmp_path, rows, kinds="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op12_vector_codes(spark, str(tmp_path)).collect()


def test_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    some = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(16)]
    rows = [(i, some(), rng.choice([None, 1, 2])) for i in range(5, 300)]
    rows += [(5, some(), 1), (5, rows[0][1], 1), (None, some(), 3), (0, None, 1), (1, [], 1), (2, [None] + some()[1:], 1),
             (3, [float("nan")] + some()[1:], 1), (4, some()[1:] + [float("-inf")], 1), (900, rows[4][1], None)]
    want, digest = brute(rows)
    found = query(spark, tmp_path, rows)
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r)[:4] for r in found], key=key) == sorted(with_label_errors(want), key=key)
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_few_and_no_rows(spark, tmp_path):
    rows = [(i, [float(i)] * 8, None) for i in range(5)]
    want, digest = brute(rows)
    found = query(spark, tmp_path / "few", rows)
    assert sorted(tuple(r) for r in found) == [(*r, digest) for r in with_label_errors(want)]
    assert query(spark, tmp_path / "none", []) == []


def test_other_lengths_and_huge_components_are_errors(spark, tmp_path):
    vectors = lambda *rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for bad in (([1.0] * 8, [1.0] * 16), ([1.0] * 9,), ([1e30] * 8,)):
        with pytest.raises(Exception, match="vectors of|beyond"):
            anchors.vector_codes(vectors(*enumerate(bad)))[0].collect()


def test_clashing_columns(spark):
    rows = [(i, [float(i * k % 7) for k in range(8)], "kept", i, 1.5) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, pq string, rest int, whole double")
    found, _ = anchors.vector_codes(vectors)
    assert found.columns == ["vec_id", "rest", "whole", "pq"]
    assert sorted((r.vec_id, r.rest) for r in found.collect()) == [(i, i) for i in range(40)]


def test_whole_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = brute(rows)
    found = queries.op12_vector_codes(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in found) == sorted((*r, digest) for r in with_label_errors(want))
