"""The automaton against edit distances by definition, and scores on held-out labels."""

from __future__ import annotations

import random
import zlib

from gatelens.llm import queries, toxicity


def distance(a, b):
    """Insertions, deletions, replacements and swaps of neighbours."""
    d = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute(terms, word):
    best = None
    for number, (text, stem, edits) in enumerate(terms):
        ends = range(len(word) + 1) if stem else [len(word)]
        for e in (distance(text, word[:n]) for n in ends):
            if e <= (1 if edits else 0) and (best is None or (e, number) < best):
                best = (e, number)
    return best and (best[1], best[0])


def test_automaton():
    rng = random.Random(2)
    for _ in range(30):
        some = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randint(low, high)))
        terms = [(t, rng.random() < 0.3, len(t) > 3 and rng.random() < 0.7) for t in {some(2, 6) for _ in range(8)}]
        automaton = toxicity.Automaton(terms)
        for _ in range(150):
            word = some(1, 8)
            found, want = automaton.match(word), brute(terms, word)
            assert (found and found[1]) == (want and want[1]), (terms, word)
            if found:
                text, stem, edits = terms[found[0]]
                assert found[1] == 0 or edits
                assert min(distance(text, word[:n]) for n in (range(len(word) + 1) if stem else [len(word)])) == found[1]


def test_quotation_is_told_from_abuse():
    matches = toxicity._Matches([("moron", False, True)])
    see = lambda text: [h[2] for h in toxicity.hits_of(text, matches)[1]]
    assert see("you are a moron") == [False] == see("a mroon, truly")
    assert see('he shouted "what a moron" and left') == [True] == see("she wrote moron on the wall")
    assert see('"hello" moron "bye"') == [False]


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op6_toxicity(spark, sf_dir).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.quality]  # junk lost the words that its label is about
    positive = [r.score for r in held if r.toxic]
    negative = sorted(r.score for r in held if not r.toxic)
    assert sum(s >= 0.7 for s in positive) >= 0.95 * len(positive)
    assert sum(s >= 0.7 for s in negative) <= 0.01 * len(negative)


def test_odd_rows(spark):
    abuse = " ".join(["such a moron here"] * 3)
    rows = [(i, f"plain words number {i}") for i in range(60)] + [(100 + i, f"{abuse} {i}") for i in range(30)]
    more = [(500, None), (501, ""), (None, abuse), (502, "moorn"), (503, "w " * 20000), (503, "w " * 20000)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i >= 100), "x") for i, _ in rows] + [(None, 1, "x"), (501, None, "x"), (3, 0, "x")],
        "doc_id long, toxic int, text string",
    )
    model = toxicity.fit(docs, labels)
    found = {(r.doc_id, (r.text or "")[:9]): r.toxicity for r in toxicity.scored(docs, model).collect()}
    assert found[(None, abuse[:9])].score > 0.7 > 0.3 > found[(500, "")].score == found[(501, "")].score
    assert found[(502, "moorn")].n_hits == 1 and found[(503, "w w w w w")].score < 0.3
    assert toxicity.scored(docs.limit(0), model).collect() == []
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.toxicity.score for r in toxicity.scored(docs, blank).collect()} == {0.5}


def test_an_id_on_many_documents_is_one_example(spark):
    rows = [(8, f"one id on {i} many quite different texts {i * i}") for i in range(300)] + [(1, "another text"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 7, 8)], "doc_id long, toxic int")
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in (1, 7, 8))
    assert toxicity.examples(docs, labels).count() == 3
