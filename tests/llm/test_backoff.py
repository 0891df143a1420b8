"""Backoff scores against dictionaries of counts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from gatelens.llm import backoff, queries
from gatelens.llm.common import documents


def brute(texts, order, alpha=0.4):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    total, all_words, out = sum(grams, Counter()), sum(map(len, words)), []
    for w, own in zip(words, grams, strict=True):
        count = lambda g: total[g] - own[g]  # noqa: E731, B023
        score = 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])  # noqa: E203
                if n == 1:
                    score += math.log10(factor * max(1, count(gram)) / max(1, all_words - len(w)))
                elif count(gram):
                    score += math.log10(factor * count(gram) / count(gram[:-1]))
                    break
                factor *= alpha
        out.append((len(w), score))
    return out


def check(rows, texts, order):
    assert len(rows) == len(texts)
    for r, (n, total) in zip(rows, brute(texts, order), strict=True):
        assert r.n_words == n and math.isclose(r.score_sum, total, abs_tol=1e-6 * max(1, n))
        assert (r.score_mean is None) if n == 0 else math.isclose(r.score_mean, total / n, abs_tol=1e-6)


def test_whole_query(spark, sf_dir):
    docs = sorted(documents(spark, sf_dir).collect(), key=lambda d: d.doc_id)
    rows = sorted(queries.op9_lm_scoring(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    check(rows, [d.text for d in docs], backoff.ORDER)


@pytest.mark.parametrize("order", [1, 3])
def test_many_blocks_and_buckets(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", "a b c"] * 3 + [texts[5]] * 20 + ["a, B; a\nß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = backoff.backoff_scores(docs, order, block_bytes=150, bucket_grams=200)
    check(sorted(found.collect(), key=lambda r: r.doc_id), texts, order)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2), (2, "x " * 9000, 3)],
                                 "doc_id long, text string, block int")
    rows = backoff.backoff_scores(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, 0), (1, 2), (1, 2), (2, 9000)]
    assert backoff.backoff_scores(docs.limit(0)).collect() == []
