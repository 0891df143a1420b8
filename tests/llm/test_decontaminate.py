"""Decontamination against a plain scan for every window."""

from __future__ import annotations

import random
import re

import pytest

from gatelens.llm import decontaminate


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    words, hit, names = words_of(text), set(), set()
    for item, passage in items:
        own = words_of(passage)
        for at in range(max(1, len(own) - 12) if own else 0):
            window = own[at : at + 13]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    if item is not None:
                        names.add(str(item))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 3000])
def test_like_a_plain_scan(spark, block_bytes):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["a", "b", "C", "der", "Êt", "9"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 13, 14, 30]) + 4)) for i in range(20)]
    items += [(20, "Z9"), (21, "z9 Y-Y"), (22, ""), (23, None), (None, some(6)), (3, some(15)), (4, items[0][1])]
    docs = [(1, None, "x"), (2, "", "x"), (3, "z9, y;Y z9", None), (3, "z9, y;Y z9", None), (None, some(50), "x")]
    docs += [(10 + i, some(200) + ". " + (rng.choice(items)[1] or "") if i % 2 else some(3), "x") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    found = decontaminate.overlap(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    rows = sorted((str(r.doc_id), str(r.text), r.overlap.n_words, r.overlap.n_hit, r.overlap["items"]) for r in found.collect())
    assert rows == sorted((str(d), str(t), *brute(t, items)) for d, t, _ in docs)


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r.overlap) for r in decontaminate.overlap(docs, items).orderBy("doc_id").collect()] == [
        (2, 0, []), (0, 0, [])]
    assert decontaminate.overlap(docs.limit(0), items).collect() == []
