"""Cache replay against a loop over the log, for whole and for cut-up histories."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gatelens.operators import replay

TTL = 60
BASE = datetime.datetime(2024, 3, 1)


def by_hand(rows):
    filled, out = {}, {}
    for request, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in filled or at >= filled[key] + datetime.timedelta(seconds=TTL):
            filled[key] = at
            out[request] = ("fill", at)
        else:
            out[request] = ("hit", filled[key])
    return out


def make_log(seed: int, n: int):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        # Mostly one busy key without pauses; others seldom; some exact ties.
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(12)}"
        at += rng.choice([0, 0, 0.25, 1, 3, 7])
        if rng.random() < 0.01:
            at += rng.choice([59.75, 60, 61, 300])
        rows.append((i, key, BASE + datetime.timedelta(seconds=at)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [1, 2, 24])
def test_equals_loop(spark, segment):
    rows = make_log(segment, 3000)
    log = spark.createDataFrame(rows, "request_id long, prompt_hash string, ts timestamp_ntz")
    found = replay.cache_replay(log, ttl_s=TTL, segment_buckets=segment).collect()
    assert {r.request_id: (r.status, r.filled_at) for r in found} == by_hand(rows)


def test_expiry_is_exclusive(spark):
    rows = [(1, "a", BASE), (2, "a", BASE + datetime.timedelta(seconds=TTL)), (3, "a", BASE + datetime.timedelta(seconds=TTL - 1))]
    log = spark.createDataFrame(rows, "request_id long, prompt_hash string, ts timestamp_ntz")
    found = {r.request_id: r.status for r in replay.cache_replay(log, ttl_s=TTL).collect()}
    assert found == {1: "fill", 2: "fill", 3: "hit"}


def test_requests_without_key_or_time_stay(spark):
    rows = [(1, "a", BASE), (2, None, BASE), (3, "a", None)]
    log = spark.createDataFrame(rows, "request_id long, prompt_hash string, ts timestamp_ntz")
    found = {r.request_id: r.status for r in replay.cache_replay(log, ttl_s=TTL).collect()}
    assert found == {1: "fill", 2: None, 3: None}


def test_empty_log(spark):
    log = spark.createDataFrame([], "request_id long, prompt_hash string, ts timestamp_ntz")
    assert replay.cache_replay(log).count() == 0


def test_copies_collapse_before_the_segments(spark):
    """A key that fills one instant a thousand times is one point of its segment."""
    rows = [(i, "a", BASE + datetime.timedelta(seconds=i % 200)) for i in range(20_000)]
    log = spark.createDataFrame(rows, "request_id long, prompt_hash string, ts timestamp_ntz")
    found = replay.cache_replay(log, ttl_s=TTL)
    assert found.filter(F.col("status") == "fill").count() == 4
    assert {r.request_id: (r.status, r.filled_at) for r in found.collect()} == by_hand(rows)


def test_batches_in_turn_equal_one_log(spark, tmp_path):
    """The foreachBatch form over uneven batches, one of them repeated after a failure."""
    from gatelens.streaming.cache import replay_sink

    rows = sorted(make_log(7, 2000), key=lambda r: (r[2], r[0]))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sink, bounds = replay_sink(out, state, ttl_s=TTL), [0, 100, 101, 900, 2000]
    instants = [r[2] for r in rows]
    cuts = [0] + [next((i for i in range(b, len(rows)) if instants[i] != instants[i - 1]), len(rows)) for b in bounds[1:]]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = spark.createDataFrame(rows[a:b], "request_id long, prompt_hash string, ts timestamp_ntz")
        for _ in range(2 if n == 1 else 1):
            sink(batch, n)
    found = spark.read.parquet(out).collect()
    assert {r.request_id: (r.status, r.filled_at) for r in found} == by_hand(rows)
