"""Fill-in-the-middle against a plain statement of its rule, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from gatelens.llm import infill, queries
from gatelens.llm.common import documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def rule(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, infill int, n string")
    found = infill.infilled(docs).select("doc_id", "text", "n", "infill.form", "infill.output", "infill")
    for r in infill.restored(found).collect():
        assert tuple(r.infill) == rule(r.doc_id, r.text) and r.restored.text == (r.text or "") and r.n == "kept"


def test_random_texts(spark):
    rng = random.Random(3)
    pieces = ["a", "über", "日本", "🙂x", " ", "\n", "\t \x0b", "<", "<P", "S>", ">", "<M", " ", "\x1c"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))), 1, "kept") for i in range(3000)]
    check(spark, rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(None, "a b c"), (None, None), (1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (5, "x <P> y")]
    rows += [(i, "wort ß " * 300_000 + "end") for i in range(6, 12)]
    check(spark, [(i, t, 1, "kept") for i, t in rows])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.infilled(empty).collect() == []


def test_outputs_without_their_marks_give_null(spark):
    rows = [("spm", "<S>b<P>a<M>c"), ("psm", "<S>b<P>a<M>c"), ("spm", "abc"), ("psm", "x<P>a<S>b<M>c"), (None, "abc"),
            ("plain", "<S>b"), ("plain", None), ("odd", "<S>b<P>a<M>c")]
    found = infill.restored(spark.createDataFrame(rows, "form string, output string")).collect()
    assert [r.restored.text for r in found] == ["acb", None, None, None, None, "<S>b", "", None]


@given(st.lists(st.text("ab <PSM>\n🙂", max_size=30), min_size=1, max_size=20), st.integers(1, 40), st.integers(1, 40))
def test_slices_and_blocks_do_not_matter(texts, slice_bytes, block_bytes):
    whole = [len(d) for _, d, _ in infill._slices(pa.array(texts))]
    old = infill.SLICE_BYTES, infill.BLOCK_BYTES
    try:
        infill.SLICE_BYTES, infill.BLOCK_BYTES = slice_bytes, block_bytes
        parts = list(infill._slices(pa.array(texts)))
        assert sum(len(d) for _, d, _ in parts) == sum(whole) and sum(len(o) - 1 for *_, o in parts) == len(texts)
        starts = np.sort(np.random.default_rng(1).integers(0, 60, 9))
        starts[0] = 0
        shifts = np.arange(9) * 7
        got = np.concatenate([s for _, s in infill._shifts(starts, shifts, 60)])
        assert got.tolist() == [int(shifts[np.searchsorted(starts, i, "right") - 1]) for i in range(60)]
    finally:
        infill.SLICE_BYTES, infill.BLOCK_BYTES = old


def test_whole_query(spark, sf_dir):
    texts = {d.doc_id: d.text for d in documents(spark, sf_dir).collect()}
    rows = queries.op11_fill_in_middle(spark, sf_dir).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "spm", "psm"}
    for r in rows:
        n, form, prefix, middle, output = rule(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(texts[r.doc_id] or ""))
