"""SimHash components against all pairs of separately computed fingerprints."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from gatelens.llm import queries, simhash
from gatelens.llm.common import documents


def brute_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids: list[int], fps: list[int]) -> list[int]:
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.array(ids)
    while True:
        least = np.where(near, label[None, :], label.max()).min(axis=1)
        if (least == label).all():
            return label.tolist()
        label = least


def test_whole_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op10_simhash_components(spark, sf_dir).collect()}
    docs = documents(spark, sf_dir).collect()
    ids, fps = [d.doc_id for d in docs], [brute_fingerprint(d.text) for d in docs]
    assert [rows[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i].component_id for i in ids] == brute_components(ids, fps)


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_links_of_planted_fingerprints(spark, cell_rows):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for base in fps[:20]:  # chains and clouds around some of them
        f = base
        for _ in range(20):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.append(f)
        fps += [base ^ (1 << b) for b in rng.sample(range(64), 20)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell_rows=cell_rows)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    expected = brute_components(list(range(len(fps))), fps)
    groups: dict = {}
    for f, e in zip(signed, expected, strict=True):
        groups.setdefault(e, set()).add(f)
    for own in groups.values():
        assert {roots.get(f, f) for f in own} == {min(own)}


def test_bound_is_below_the_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 5000, np.int64)
    b = a ^ (rng.integers(0, 2**63, 5000, np.int64) & rng.integers(0, 2**63, 5000, np.int64))
    exact = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))
    bound = simhash.manhattan(simhash.embed(a), simhash.embed(b))
    assert (bound <= exact).all()
    counts = lambda x: sum(((x.view(np.uint64) >> np.uint64(2 * s)) & np.uint64(3) != 0) for s in range(32))
    assert counts(a).max() <= 32


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one"), (7, "one"), (8, "One"), (None, "one"), (1, "x y z " * 3000)]
    found = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in found) == sorted(
        [(5, 3), (3, 3), (9, 3), (7, 7), (7, 7), (8, 7), (-1, 7), (1, 1)]
    )
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, cell int")
    assert simhash.simhash_components(empty).collect() == []
    kept = simhash.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [1, 3, 7]  # the unnamed copy is of 7's component


def test_one_row_of_each_component_stays(spark):
    some = lambda seed: " ".join(str(random.Random(seed + k).random()) for k in range(0, 9000, 100))
    a, b, c = some(1), some(2), some(3)
    rows = [(5, a, "x"), (5, b, "x"), (1, b, "x"), *[(None, c, "x")] * 5, (None, a, "x"), (None, c, "y"), (7, None, "x")]
    for own in (rows, rows[::-1]):
        docs = spark.createDataFrame(own, "doc_id long, text string, lang string").repartition(3)
        kept = simhash.near_duplicates_removed(docs).collect()
        assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted([(5, a), (1, b), (-1, c), (7, "")])
        assert kept[0].asDict().keys() == {"doc_id", "text", "lang"}
    alone = spark.createDataFrame([(4, a), (4, b), (4, a), (None, c)], "doc_id long, text string")
    kept = simhash.near_duplicates_removed(alone).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(4, a), (4, b), (-1, c)])
