"""Packing against the tokenizer itself and against best fit one piece at a time."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gatelens.llm import packing, queries
from gatelens.llm.common import documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def real_ids(texts):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return [[*e.ids, 1] for e in own.encode_batch(texts, add_special_tokens=False)]


def assert_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_whole_query(spark, sf_dir):
    rows = queries.op2_packing(spark, sf_dir).collect()
    docs = documents(spark, sf_dir).collect()
    ids = dict(zip([d.doc_id for d in docs], real_ids([d.text or "" for d in docs]), strict=True))
    covered = {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, spans in covered.items():
        assert [s for s, _ in sorted(spans)] == list(np.cumsum([0, *[n for _, n in sorted(spans)]])[:-1])
        assert sum(n for _, n in spans) == len(ids[doc])
    assert set(covered) == set(ids)
    total = sum(map(len, ids.values()))
    assert assert_gapless(rows) <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packs_like_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 2000))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    table, windows = packing.best_fit_decreasing(histogram, 64)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(64 - n)
    assert windows == len(rooms)
    filled = np.zeros(windows, int)
    for n, count in histogram.items():
        own = table[table[:, 0] == n]
        for i in range(count):
            _, rank, per, first, _ = own[own[:, 1] <= i][-1]
            filled[first + (i - rank) // per] += n
    assert sorted(64 - filled) == sorted(rooms)


def test_chunks_tokenize_like_whole_texts(spark):
    texts = ["", " ", "\n\n a  b\t\tc  ", "don't  stop now　　x", "\u1680a\u2003\u2003b\u2029\u202f c\u205f", "a\x1cb \x1f c", "<|endoftext|> x", "é" * 3000, "x" * 9000,
             "🙂🙂 ok!!  \r\n\r\nend ", "  line\x85next", "1 22  333 't 'S"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.tokenize(rows, RANKS, public_tokenizers.PATTERN).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        by.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert [by[i] for i in range(len(texts))] == real_ids(texts)


def test_odd_rows_and_sequences(spark):
    rows = [(1, None, "q"), (None, "a b", "q"), (2, "a b", None), (2, "a b", None), (3, "word " * 5000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    packed = packing.pack(packing.tokenize(docs, RANKS, public_tokenizers.PATTERN))
    found = packed.collect()
    assert_gapless(found)
    assert sum(r.length for r in found) == sum(len(i) for i in real_ids([r[1] or "" for r in rows]))
    for r in packing.sequences(packed).collect():
        own = sorted((p for p in found if p.sequence_id == r.sequence_id), key=lambda p: p.offset)
        data = b"".join(p.ids for p in own)
        assert r.ids[: 4 * r.n_ids] == data and set(r.ids[4 * r.n_ids :]) <= {0}
        assert len(r.ids) == (4 * r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 4 * 2048)
    assert packing.pack(packing.tokenize(docs.limit(0), RANKS, public_tokenizers.PATTERN)).collect() == []


def test_added_tokens_as_the_tokenizer_finds_them(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "plain", None]
    texts.append("word " * 2047 + "<|endoftext|> tail")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [[*e.ids, 1] for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert expected[0] == [64, 50256, 65, 1]
    for r in queries.packed_pieces(rows).collect():
        piece = expected[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(expected[r.doc_id]) and len(piece) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
