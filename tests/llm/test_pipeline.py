"""The pipeline against plain-Python versions of its decisions, stage by stage."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gatelens.llm import ordinal
from gatelens.llm.common import documents
from tests.llm.test_decontaminate import brute as brute_overlap
from tests.llm.test_secret_scan import brute as brute_secrets
from tests.llm.test_simhash import brute_components, brute_fingerprint


def run_stages(spark, docs, sf_dir):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs)
    return out


def test_stages_and_run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    stages = run_stages(spark, docs, sf_dir)
    assert all(s.columns == docs.columns and s.dtypes == docs.dtypes for s in stages[:-1])
    good, single, clean, masked = ({r.doc_id: r.text for r in s.collect()} for s in stages[:-1])

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.fit(docs, ordinal.label_grades(labels))
    assert set(good) == {d.doc_id for d in docs.collect() if model.tails(d.text)[0] >= 0.5}

    ids = sorted(good)
    components = brute_components(ids, [brute_fingerprint(good[i]) for i in ids])
    assert set(single) == {i for i, c in zip(ids, components, strict=True) if i == c}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {w for _, t in items for w in _windows(t)}
    kept = {i for i, t in single.items() if not any(w in _padded(t) for w in windows) or not _hit(t, items)}
    assert set(clean) == kept

    assert set(masked) == set(clean)
    for i, text in clean.items():
        assert (masked[i] == text) or brute_secrets(text) or "[secret]" in masked[i]
        assert not brute_secrets(masked[i])
    assert {r.doc_id: r.n_chars for r in stages[3].collect()} == {i: len(t) for i, t in masked.items()}

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    pieces, whole = {}, corpus_pipeline.run(spark, sf_dir).collect()
    for r in sorted(whole, key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(masked)
    for i, text in masked.items():
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        for r in pieces[i]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in pieces[i]) == len(ids)


def _words(text):
    from tests.llm.test_decontaminate import words_of

    return words_of(text)


def _padded(text):
    return " " + " ".join(_words(text)) + " "


def _windows(text):
    words = _words(text)
    return [" " + " ".join(words[i : i + 13]) + " " for i in range(max(1, len(words) - 12) if words else 0)]


def _hit(text, items):
    n_words, n_hit, _ = brute_overlap(text, items)
    return n_hit > 0 and 20 * n_hit >= n_words


def test_odd_documents(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, overlap string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (2, "", "en", "s", 0, None), (None, "plain text here", "en", "s", 15, "x")]
    docs = spark.createDataFrame(rows, schema)
    stages = run_stages(spark, docs, sf_dir)
    assert all(s.columns == docs.columns for s in stages[:-1])
    assert all(s.count() == 0 for s in run_stages(spark, docs.limit(0), sf_dir))
