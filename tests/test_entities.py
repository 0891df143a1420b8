"""Typed entities against statements of the rules in plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions import entities
from gatelens.operators import security
from gatelens.plans import samples


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def passing(hit, check):
    digits = re.sub("[^0-9]", "", hit)
    if check == "luhn":
        return hit if luhn(digits) else None
    if check == "ssn":
        bad = digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000"
        return None if bad else hit
    if check == "iban":
        for drop in range(3):
            words = hit.split(" ")
            part = " ".join(words[: max(1, len(words) - drop)])
            if (drop == 0 or len(words[-1]) <= 4) and iban(part.replace(" ", "")):
                return part
        return None
    return hit


def redacted(text):
    spans = []
    for rule, (kind, pattern, score, check, words) in enumerate(cfg.ENTITY_RULES):
        end = 0
        hits = list(re.finditer(pattern, text))
        for n, m in enumerate(hits):
            before, end = text[end : m.start()], m.end()
            beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
            if any(c.isalnum() or c == "_" for c in beside):
                continue
            part = passing(m.group(), check)
            points = 1.0 if check in ("luhn", "iban") else score
            if any(w in before[-cfg.ENTITY_CONTEXT_CHARS :].lower() for w in words):
                points = min(1.0, max(points + cfg.ENTITY_CONTEXT_BOOST, cfg.ENTITY_SCORE_THRESHOLD))
            if part and points >= cfg.ENTITY_SCORE_THRESHOLD:
                spans.append((m.start(), m.start() + len(part), (points, len(part), -m.start(), -rule), kind))
    marks = [None] * len(text)  # the run that each character belongs to
    runs = []
    for start, stop, rank, kind in sorted(spans):
        if runs and runs[-1][1] > start:
            runs[-1] = (runs[-1][0], max(runs[-1][1], stop), *max(runs[-1][2:], (rank, kind)))
        else:
            runs.append((start, stop, rank, kind))
    for k, (start, stop, _, _) in enumerate(runs):
        marks[start:stop] = [k] * (stop - start)
    out = []
    for i, (c, k) in enumerate(zip(text, marks, strict=True)):
        if k is None:
            out.append(c)
        elif i == 0 or marks[i - 1] != k:
            out.append(f"[REDACTED_{runs[k][3]}]")
    return "".join(out)


TEXTS = [
    *samples.ENTITIES,
    *samples.PII,
    "",
    "no numbers here",
    "é4012888888881881 4012888888881881é 4012888888881881",
    "4012888888881881",
    "GB82 WEST 1234 5698 7654 32",
    "GB82 WEST 1234 5698 7654 32 AND THEN",
    "passport 123456789012",
    "ssn passport license 123456789 and a1234567",
    "call (020) 7946 0958 or 4012 8888 8888 1881, +1 415 555 0199 10.1.2.3",
    "driver " + " ".join(f"D{i:07d}" for i in range(2000)),
    "x" * 50_000 + " 4012888888881881 " + "y" * 50_000,
]


def test_spans_equal_the_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").repartition(4)
    found = df.select("i", entities.replace_spans(F.col("text"), entities.entity_spans(F.col("text"))).alias("text"))
    got = {r.i: r.text for r in found.collect()}
    assert got == {i: redacted(t) for i, t in enumerate(TEXTS)}


def test_null_text_and_other_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "driver D1234567")], "start int, text string")
    out = security.entity_redact(df)
    assert out.columns == ["start", "text"]
    assert {(r.start, r.text) for r in out.collect()} == {(1, None), (2, "driver [REDACTED_US_DRIVER_LICENSE]")}


def test_threshold(spark):
    df = spark.createDataFrame([("at 10.0.0.1 driver D1234567",)], "text string")
    high = security.entity_redact(df, threshold=0.62).first().text
    assert high == "at 10.0.0.1 driver [REDACTED_US_DRIVER_LICENSE]"


@pytest.mark.parametrize("kind", [k for k in cfg.ENTITY_TYPES if k != "PERSON"])
def test_every_type_is_found(kind):
    assert any(f"[REDACTED_{kind}]" in redacted(t) for t in TEXTS)


def test_texts_without_a_match_are_searched_once_per_rule(spark):
    """The gaps between matches, a second search, are only looked for behind a match."""
    spans = spark.createDataFrame([("a",)], "text string").select(entities.entity_spans(F.col("text")))
    plan = spans._jdf.queryExecution().analyzed().toString()
    rules = len(cfg.ENTITY_RULES)
    assert plan.count("split(") >= rules
    assert len(re.findall(r"CASE WHEN \(size\(namedlambdavariable\(\)[^)]*\) > 0\) THEN cast\(filter|CASE WHEN \(size\(lambda [^)]*\) > 0\) THEN cast\(filter", plan)) == rules
