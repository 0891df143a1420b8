"""Sketches against their definition, and components against all pairs of full sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gatelens.llm import hyperminhash, queries
from gatelens.llm.common import documents, lower_words


def shingles(text):
    words = lower_words(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(docs):
    """[(doc_id, set size, component id)] by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    holders, above = {}, list(range(len(docs)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                above[top(i)] = top(j)
    names = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None and (names.get(top(i)) is None or doc_id < names[top(i)]):
            names[top(i)] = doc_id
    return [(doc_id, len(sets[i]), names.get(top(i))) for i, (doc_id, _) in enumerate(docs)]


def found(docs, **options):
    return [tuple(r) for r in hyperminhash.near_components(docs, **options).collect()]


key = lambda r: tuple((x is None, x or 0) for x in r)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def collection(seed, texts, copies):
    rng = random.Random(seed)
    rows = []
    for _ in range(texts):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([2, 5, 8, 12, 30, 60, 200, 900]))]
        rows.append(base)
        rows += [edited(rng, base, rng.randint(0, max(1, len(base) // 16))) for _ in range(rng.randint(0, copies))]
        if rng.random() < 0.5:
            rows += [base + ["end"], base[1:]]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_registers_and_bands():
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 2**64, 300, np.uint64))
    sketch = hyperminhash.registers(hashes)
    for bucket in range(256):
        own = [int(h) for h in hashes if int(h) >> 56 == bucket]
        if not own:
            assert sketch[bucket] == hyperminhash.EMPTY
            continue
        bits = f"{(min(own) >> 4) & (2**52 - 1):052b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert sketch[bucket] == zeros << 10 | int((bits[zeros + 1 :] + "0" * 11)[:10], 2)
    one = np.full(256, hyperminhash.EMPTY, np.uint16)
    assert len(hyperminhash.bands(one)) == 0
    one[7] = 3
    assert len(hyperminhash.bands(one)) == 2 * hyperminhash.BANDS
    assert (hyperminhash.bands(sketch) == hyperminhash.bands(sketch.copy())).all() and len(hyperminhash.bands(sketch)) == 51
    low = hyperminhash.registers(np.array([5, 3 << 56], np.uint64))  # all 52 bits are zero
    assert low[0] == 52 << 10 and low[3] == 52 << 10


@pytest.mark.parametrize("size", [30, 300, 5000])
def test_estimate_is_near_and_free_of_chance(size):
    rng = np.random.default_rng(3)
    off, chances = [], []
    for _ in range(60):
        both = rng.integers(0, 2**64, 8 * size, np.uint64)
        a, b = np.unique(both[: 9 * size // 2]), np.unique(both[size // 2 : 5 * size])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = hyperminhash.registers(a)[None], hyperminhash.registers(b)[None]
        guess, differ = hyperminhash.estimate(x, y, np.array([len(a)]), np.array([len(b)]))
        off.append(float(guess[0]) - true)
        assert differ[0] <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert hyperminhash.may_be_near(x, y, np.array([len(a)]), np.array([len(b)]))[0]
        u, v = (np.unique(rng.integers(0, 2**64, size, np.uint64)) for _ in range(2))
        x, y = hyperminhash.registers(u)[None], hyperminhash.registers(v)[None]
        chances.append(float(((x == y) & (x != hyperminhash.EMPTY)).sum() / ((x != hyperminhash.EMPTY) | (y != hyperminhash.EMPTY)).sum()))
    assert abs(np.mean(off)) < 0.015 and np.abs(off).max() < 0.12
    assert abs(np.mean(chances) - hyperminhash.chance(np.array([size]))[0]) < 0.0005


def test_components_equal_all_pairs(spark):
    rows = collection(4, 150, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(found(docs), key=key) == sorted(brute(rows), key=key)


def test_large_groups_and_small_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(90)]
    phrase = [f"p{i}" for i in range(12)]
    rows = [" ".join(edited(rng, base, rng.randint(1, 3))) for _ in range(350)]
    rows += [" ".join(phrase + [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(3, 14))]) for _ in range(350)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows), key=key)
    assert sorted(found(docs, cell_rows=100), key=key) == want


def test_later_rounds_compare_only_nodes_with_possible_pairs(spark, monkeypatch):
    rng = random.Random(9)
    phrase = [f"p{i}" for i in range(24)]
    rows = [" ".join(phrase + [f"v{rng.randrange(10**6)}" for _ in range(10)]) for _ in range(200)]  # share cells, but unlike
    for k in range(4):
        chain = [f"c{k}x{i}" for i in range(60)]
        rows += [" ".join(chain[3 * i : 3 * i + 40]) for i in range(6)]
    rows = list(enumerate(rows))
    docs, sizes, rest = spark.createDataFrame(rows, "doc_id long, text string"), [], hyperminhash._rest_pairs

    def counted(dealt, *others):
        sizes.append(dealt.count())
        return rest(dealt, *others)

    none = lambda cells, *_: cells.limit(0).selectExpr("node AS a", "node AS b")
    monkeypatch.setattr(hyperminhash, "_hub_links", none)  # the rounds after the hubs find all links
    monkeypatch.setattr(hyperminhash, "_rest_pairs", counted)
    assert sorted(found(docs), key=key) == sorted(brute(rows), key=key)
    assert len(sizes) > 1 and sizes[0] > 200 and max(sizes[1:]) < sizes[0] / 4


def test_bands_by_their_rule():
    rng = np.random.default_rng(6)
    for occupied in (1, 3, 8, 9, 30, 120, 255, 256):
        x = np.full(256, hyperminhash.EMPTY, np.uint16)
        x[rng.permutation(256)[:occupied]] = rng.integers(0, 50000, occupied)
        for other in (x.copy(), np.where(np.arange(256) == np.nonzero(x != hyperminhash.EMPTY)[0][0], 60000, x).astype(np.uint16)):
            fronts = [[[(b, int(s[b])) for b in order if s[b] != hyperminhash.EMPTY][:5] for order in hyperminhash._ORDERS] for s in (x, other)]
            same = [p == q for p, q in zip(*fronts, strict=True)]
            found = hyperminhash.bands(x)[:51] == hyperminhash.bands(other)[:51]
            assert found.tolist() == same


def test_a_pair_belongs_to_its_first_cell():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 50000, 256).astype(np.uint16)
    y = np.where(rng.random(256) < 0.1, 60000, x).astype(np.uint16)
    shared = [c for c in hyperminhash.bands(x).tolist() if c in hyperminhash.bands(y).tolist()]
    pair = np.array([0]), np.array([1])
    assert len(shared) > 3
    assert [bool(hyperminhash._first_shared(np.array([x, y]), *pair, c)[0]) for c in shared] == [True] + [False] * (len(shared) - 1)


def test_spanning_pairs_connect_and_nothing_more():
    assert hyperminhash._spanning([1, 1, 2, 4, 3], [2, 3, 3, 5, 4]) == [0, 1, 3, 4]


def test_texts_that_are_not_needed_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.xxhash64("id").alias("node"), F.col("id").cast("string").alias("text"))
    needed = rows.filter("text % 50 = 0").select("node")
    for most_bits, others in ((1 << 28, 0.2), (1 << 15, 0.2), (64, 1)):
        some = hyperminhash._perhaps(rows, needed, most_bits)
        kept = {r.node for r in some.collect()}
        assert some.columns == rows.columns and kept >= {r.node for r in needed.collect()}
        assert len(kept) - 400 <= 20_000 * others
    assert hyperminhash._perhaps(rows, needed.limit(0)).isEmpty()
    assert "hashpartitioning(node" not in hyperminhash._perhaps(rows, needed)._jdf.queryExecution().toString()


def test_full_sets_shuffle_only_needed_texts(spark, monkeypatch):
    """Whatever else a join would do: the rows that go into the grouping by node are the needed ones and a few."""
    docs = spark.createDataFrame([(i, f"w{i} a{i} b{i} c{i} d{i}") for i in range(3000)], "doc_id long, text string")
    needed = hyperminhash.signatures(docs.filter("doc_id < 40")).selectExpr("place AS node")
    seen, rest = [], hyperminhash._perhaps

    def counted(rows, *others):
        seen.append(rest(rows, *others).count())
        return rest(rows, *others)

    monkeypatch.setattr(hyperminhash, "_perhaps", counted)
    assert hyperminhash._full(docs, needed, 4).count() == 40
    assert len(seen) == 1 and 40 <= seen[0] < 300


def test_cells_are_made_and_shuffled_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 50000, (30, 256)).astype(np.uint16)
    near = np.where(rng.random(base.shape) < 0.05, 60000, base).astype(np.uint16)[:20]
    sketches = [*base, *near]
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sketches)], "node long, sketch binary")
    plans, rest = [], hyperminhash.written

    def watched(df, purpose):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return rest(df, purpose)

    monkeypatch.setattr(hyperminhash, "written", watched)
    cells = hyperminhash._cells(nodes)
    holders = {}
    for i, s in enumerate(sketches):
        for k, c in enumerate(hyperminhash.bands(s).tolist()):
            holders.setdefault(c, []).append((c, i, k % hyperminhash.HUB_ROUNDS))
    assert cells.columns == ["cell", "node", "turn"]
    assert sorted(map(tuple, cells.collect())) == sorted(r for h in holders.values() if len(h) > 1 for r in h)
    assert sum(p.count("MapInArrow") for p in plans) == 1


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "One two"), (7, "one TWO"), (8, "one  two"), (None, "one two"), (1, "x y z " * 3000),
            (2, "x y z " * 2900), (4, "a b c d"), (6, "a b c d e"), (10, "a b c"), (None, "only here"), (11, "É é"), (12, "é é")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, root string")
    assert sorted(found(docs), key=key) == sorted(brute(rows), key=key)
    assert found(docs.limit(0)) == []


def test_whole_query(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in documents(spark, sf_dir).collect()]
    rows = queries.op13_minhash_components(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in rows) == sorted((*r, r[0] == r[2]) for r in brute(docs))
