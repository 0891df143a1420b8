"""Measures by hand, verdicts on labelled documents, and odd rows."""

from __future__ import annotations

import random
from collections import Counter

from gatelens.llm import quality_rules as rules
from gatelens.llm import queries
from gatelens.llm.common import documents


def test_measures():
    words, chars, symbols, doubles, repeated, *_ = rules.measure("a b c\na b c\n\n \nd é#<\tx\na b c")
    assert (words, chars, symbols, doubles, repeated) == (12, 14, 2, 2, 9)
    assert rules.measure(None)[:5] == (0, 0, 0, 0, 0) == rules.measure(" \n")[:5]
    text = ("x y z w " * 700 + "end ") * 2
    own = text.split()
    grams = Counter(zip(own, own[1:], own[2:]))
    inside = {i + k for i in range(len(own) - 2) if grams[tuple(own[i : i + 3])] > 1 for k in range(3)}
    assert rules.measure(text)[4] == len(inside)


def test_labelled_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op4_quality_rules(spark, sf_dir).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}###" for i in range(60))
    rows = [(1, None, None, None, 5), (2, "", "en", None, 5), (None, long, None, "s", 5), (3, long, "en", "s", 5),
            (3, long, "en", "s", 5), (4, junk, "en", "s", 5), (5, long * 500, "en", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    found = sorted((r.doc_id or -1, r.base_failed, r.kept) for r in rules.judged(docs).collect())
    assert found == [(-1, False, True), (1, True, False), (2, True, False), (3, False, True), (3, False, True),
                     (4, False, False), (5, True, False)]
    assert rules.judged(docs.limit(0)).collect() == []


def test_large_groups_have_their_own_thresholds(spark):
    dots = " ".join(f"w{i}.!" for i in range(60))  # usual in one source, odd elsewhere
    plain = " ".join(f"w{i}" for i in range(60))
    rows = [(i, dots, "en", "a") for i in range(50)] + [(100 + i, plain, "en", "b") for i in range(50)]
    docs = spark.createDataFrame([*rows, (200, dots, "en", "b")], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in rules.judged(docs).filter("kept").collect()}
    assert kept == {*range(50), *range(100, 150)}


def test_every_rule_fires(spark):
    rng = random.Random(4)
    words = lambda n, chars=5: ["".join(rng.choices("abcdefghijklmnop", k=chars)) for _ in range(n)]
    usual = lambda: " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words(rng.randint(60, 90)))
    odd = {
        1: "\n".join([" ".join(words(20)) for _ in range(3)] + ["same"] * 5),  # lines
        2: " ".join(words(40) + 2 * words(14)),  # repeats
        3: " ".join(words(60)).upper(),  # capitals
        4: " ".join(w + "#" for w in words(60)),  # marks
        5: " ".join(words(60, 15)),  # word length
    }
    rows = [(100 + i, usual(), "en", "a") for i in range(200)] + [(i, text, "en", "a") for i, text in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = rules.judged(docs).collect()
    assert {r.doc_id for r in found if not r.kept} == set(odd) and not any(r.base_failed for r in found)


def test_limits_differ_between_groups(spark):
    sf_dir = "/root/testdata/sf0.1"
    slim = rules.measured(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    slim = slim.select("doc_id", "lang", "source", "measures.*")
    own = rules.group_thresholds(slim.filter("n_words >= 50 and 2 * n_repeat_words <= n_words")).collect()
    assert len({r.most_marks for r in own}) > 20 and len({r.most_word_length for r in own}) > 20
