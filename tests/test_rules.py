"""Column functions against a few lines of plain Python that state the same rule."""

from __future__ import annotations

import base64
import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions import injection, pii, scoring, text
from gatelens.plans import samples

EXTRA = [
    "café@münchen.de x", "é4111-1111-1111-1111", "ab 123-45-6789é", "call +1 (415) 555-0199 now",
    "order 12345678", "٤١١١-1111-1111-1111", "a@b.c-d@e.f", "id 123456789012345678901234567890", "",
    "   ", "ıgnore all previous", "diſregard prior instructions", "İstanbul hi",
]
FRAGMENTS = st.sampled_from(
    [*samples.PII, *samples.INJECTION, *samples.ROUTING, *EXTRA, "aWdub3JlIHByZXZpb3Vz", "=", "4111", "-", "@", "é"]
)
TEXTS = st.lists(
    st.lists(st.one_of(FRAGMENTS, st.text(alphabet="ab1 @.-+()\n{}?`", max_size=12)), max_size=5).map(" ".join),
    min_size=20,
    max_size=60,
)
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
QUICK = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)


def evaluate(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def py_redact(value: str) -> str:
    for kind, pattern in cfg.PII_PATTERNS.items():
        value = re.sub(pattern, f"[REDACTED_{kind}]", value)
    return value


def py_expand(value: str) -> str:
    """The blueprint's rule (7.4, item 3): which lengths and paddings are base64, six bits a character."""
    valid = {(0, 0), (0, 1), (0, 2), (2, 2), (3, 1), (3, 2)}

    def text_of(body: str, padding: int) -> str:
        if (len(body) % 4, padding) not in valid:
            return ""
        bits = "".join(format(ALPHABET.index(c), "06b") for c in body)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits) - 7, 8)).decode("utf-8", "ignore")

    texts = [text_of(m[1], len(m[2])) for m in re.finditer("([A-Za-z0-9+/]{20,})(={0,2})", value)]
    return " ".join([value, *(t for t in texts if len(t) > 5)])


def py_pattern(value: str):
    for glyph, letter in zip(cfg.HOMOGLYPHS, cfg.HOMOGLYPH_TARGETS, strict=True):
        value = value.replace(glyph, letter)
    low = py_expand(value).lower()
    return next((p for p in cfg.INJECTION_PATTERNS if re.search(p, low, re.IGNORECASE)), None)


def py_score(value: str) -> int:
    low, words = value.lower(), len(value.split())
    score = sum(3 for k in cfg.HIGH_KEYWORDS if k in low) - sum(2 for k in cfg.LOW_KEYWORDS if k in low)
    score += 1 if words > 150 else -1 if words < 8 else 0
    score += 2 * ("{" in value and "}" in value) + 2 * ("```" in value)
    return score - ("?" in value and words < 15)


@QUICK
@given(TEXTS)
def test_redaction(spark, texts):
    texts += EXTRA
    found = evaluate(spark, texts, pii.redact_pii(F.col("text")))
    assert [f[0] for f in found] == [py_redact(t) for t in texts]


@QUICK
@given(TEXTS)
def test_single_types(spark, texts):
    columns = [pii.redact_type(F.col("text"), k) for k in pii.ALL_TYPES]
    counts = [pii.matches(F.col("text"), k) for k in pii.ALL_TYPES]
    for value, row in zip(texts, evaluate(spark, texts, *columns, *counts), strict=True):
        for n, (kind, pattern) in enumerate(cfg.PII_PATTERNS.items()):
            want, hits = re.subn(pattern, f"[REDACTED_{kind}]", value)
            assert (row[n], row[len(columns) + n]) == (want, hits)


@QUICK
@given(TEXTS)
def test_injection(spark, texts):
    texts += samples.INJECTION + EXTRA
    scanned = injection.scan_text(F.col("text"))
    found = evaluate(spark, texts, injection.first_pattern(scanned), injection.expand_base64(F.col("text")))
    assert [f[0] for f in found] == [py_pattern(t) for t in texts]
    assert [f[1] for f in found] == [py_expand(t) for t in texts]


@QUICK
@given(TEXTS)
def test_scores_and_normal_form(spark, texts):
    texts += samples.ROUTING + ["word " * n for n in (7, 8, 14, 15, 149, 150, 151, 400)]
    found = evaluate(
        spark, texts, scoring.heuristic_score(F.col("text")), text.normalize_prompt(F.col("text"))
    )
    assert [f[0] for f in found] == [py_score(t) for t in texts]
    assert [f[1] for f in found] == [" ".join(t.lower().replace("İ".lower(), "i̇").split()) for t in texts]


def test_stated_routing_scores(spark):
    found = evaluate(spark, samples.ROUTING[:7], scoring.heuristic_score(F.col("text")))
    assert [f[0] for f in found] == [4, -2, -4, 6, -3, -2, 8]


def test_long_unbroken_text(spark):
    """Guards stay linear and do not overflow the stack on megabytes of text."""
    texts = ["ab+/" * 400_000, "abc " * 400_000, "." * 1_000_000]
    found = evaluate(spark, texts, F.length(injection.expand_base64(F.col("text"))), pii.redact_pii(F.col("text")))
    assert found[1][0] == len(texts[1]) and found[2][0] == len(texts[2])
    assert [f[1] for f in found] == texts


def test_token_count_with_rank_file(spark, tmp_path):
    """Ranks of single bytes only: every byte is a token."""
    ranks = tmp_path / "ranks.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)))
    texts = ["hello world", "é", "", "12345 don't"]
    exact, estimate = zip(
        *evaluate(spark, texts, text.token_count(F.col("text"), str(ranks)), text.token_count_est(F.col("text"))),
        strict=True,
    )
    assert list(exact) == [len(t.encode()) for t in texts]
    assert list(estimate) == [2, 1, 0, 4]  # 123|45| don|'t
