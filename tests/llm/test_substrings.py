"""Chunk properties, planted passages, and the whole query against all windows of all texts."""

from __future__ import annotations

import random

from gatelens.llm import queries, substrings
from gatelens.llm.common import documents


def test_chunks_are_of_nearby_bytes_only():
    rng = random.Random(4)
    data = "".join(rng.choice("abcdefgé ü🙂") for _ in range(5000)).encode()
    own = substrings.chunks(data)
    assert all(a < c and b == c + substrings.WINDOW for (a, b), (c, _) in zip(own, own[1:], strict=False))
    assert max(b - a for a, b in own) <= substrings.SPREAD + substrings.WINDOW and len({b - a for a, b in own}) > 20
    moved = substrings.chunks(b"some bytes before" + data)
    at = len(b"some bytes before")
    assert len({(a + at, b + at) for a, b in own} - set(moved)) <= 2
    assert substrings.chunks(b"") == [] and substrings.chunks(b"x" * (substrings.LEAST - 1)) == []


def test_equal_passages_hold_a_chunk():
    rng = random.Random(5)
    some = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    for _ in range(400):
        passage, before, other = some(substrings.LEAST), some(rng.randint(0, 200)), some(rng.randint(0, 200))
        inside = []
        for lead in (before, other):
            data = lead + passage + some(rng.randint(0, 200))
            spans = [(a - len(lead), b - len(lead)) for a, b in substrings.chunks(data)]
            inside.append({s for s in spans if s[0] >= 0 and s[1] <= len(passage)})
        assert inside[0] & inside[1]


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passages, rows = [some(55) for _ in range(10)], []
    for i in range(100):
        rows.append((i, f"{some(80)} {passages[i % 10]} {some(40)}" if i < 60 else some(150)))
    found = {r.doc_id: r for r in substrings.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if 10 <= i < 60:
            left = found[i].text.split()
            assert found[i].copies.first_docs[0] == i % 10
            assert len(text.split()) - len(left) >= 30, i
        else:
            assert found[i].text == text and found[i].copies.removed == 0


def test_odd_rows(spark):
    text = " ".join(f"wort{i * i}ß" for i in range(200))
    rows = [(1, None, "a"), (2, "", "a"), (3, text, "a"), (3, text, "a"), (3, "other " + text, "b"), (None, text, "c"),
            (4, text[:400], "d"), (9, "again " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    found = substrings.without_copies(docs).collect()
    by = sorted((str(r.doc_id), -1 if r.text is None else len(r.text)) for r in found)
    assert by[0] == ("1", -1) and by[1] == ("2", 0) and len(by) == 8
    assert [n for d, n in by if d == "3"].count(len(text)) == 2 or sorted(n for d, n in by if d == "3")[-1] >= len(text)
    assert next(n for d, n in by if d == "None") < 120 and next(n for d, n in by if d == "4") < 120
    assert substrings.without_copies(docs.limit(0)).collect() == []


def test_short_passages_go_whole(spark):
    rng = random.Random(12)
    some = lambda n, size: " ".join("".join(rng.choice("abcdefghijklmnoprstuß") for _ in range(size)) for _ in range(n))
    passages = [some(51 + i % 10, 3 + i % 4) for i in range(150)]
    rows, rest = [], {}
    for i in range(450):
        before, after = some(40, 6), some(40, 6)
        before, after = f"{before}{i // 150}", f"{i // 150}{after}"  # no byte beside a passage is equal
        rows.append((i, before + "{" + passages[i % 150] + "}" + after))
        rest[i] = rows[-1][1] if i < 150 else before + "{}" + after
    found = substrings.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {
        i: text.replace("{}", "") if i >= 150 else text for i, text in rest.items()
    }
    assert [(r.doc_id, r.copies.first_docs) for r in found if r.doc_id >= 150 and r.copies.first_docs != [r.doc_id % 150]] == []


def exact(docs):
    """doc_id -> text without bytes in windows of MIN_RUN bytes that stand at an earlier place."""
    seen, out, size = set(), {}, substrings.MIN_RUN
    for doc_id, text in sorted(docs):
        data, spans = (text or "").encode(), []
        for at in range(len(data) - size + 1):
            window = data[at : at + size]
            if window not in seen:
                seen.add(window)
            elif spans and at <= spans[-1][1]:
                spans[-1][1] = at + size
            else:
                spans.append([at, at + size])
        for a, b in reversed(spans):
            while data[a] & 0xC0 == 0x80:
                a += 1
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            data = data[:a] + data[b:]
        out[doc_id] = data.decode()
    return out


def test_every_copied_window_goes(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in documents(spark, sf_dir).collect()]
    rows = queries.op1_substring_dedup(spark, sf_dir).collect()
    found = {r.doc_id: r.text for r in rows}
    expected, whole = exact(docs), dict(docs)
    assert len(found) == len(docs)
    assert {i: (len(found[i]), len(expected[i])) for i in expected if found[i] != expected[i]} == {}
    assert all(len(whole[r.doc_id]) - len(r.text) == r.removed_chars for r in rows)
