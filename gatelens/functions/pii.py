"""Pattern redaction of personal data (first pass) as column expressions.

Python's ``\\w \\d \\b`` follow Unicode, Java's do so only with ``(?U)``; every
pattern is therefore compiled with that flag.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens import settings as cfg

ALL_TYPES = tuple(cfg.PII_PATTERNS)

# Looked at before anything else of a pattern, so that positions where no match
# can begin cost one character test instead of a Unicode word-boundary test.
_BEGINS = {"CARD": r"(?=\d)", "SSN": r"(?=\d)", "AADHAAR": r"(?=\d)", "PHONE": r"(?=[\d+(])"}


def _java(kind: str) -> str:
    return "(?U)" + _BEGINS.get(kind, "") + cfg.PII_PATTERNS[kind]


def _may_match(text: Column, kind: str) -> Column:
    """Cheap necessary condition: an ``@``, or the four digits all others need."""
    if kind == "EMAIL":
        return F.contains(text, F.lit("@"))
    return F.rlike(text, F.lit(r"\p{Nd}{4}"))


def _replaced(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, F.lit(_java(kind)), F.lit(f"[REDACTED_{kind}]"))


def redact_type(text: Column, kind: str) -> Column:
    return F.when(_may_match(text, kind), _replaced(text, kind)).otherwise(text)


def redact_pii(text: Column, types=ALL_TYPES) -> Column:
    """All patterns in their fixed order; texts that cannot match skip them.

    Redacting mail addresses can only remove digits, so the digit test may look
    at the text as it came in.
    """
    mailed = redact_type(text, "EMAIL") if "EMAIL" in types else text
    numeric = [kind for kind in types if kind != "EMAIL"]
    if not numeric:
        return mailed
    return F.when(_may_match(text, numeric[0]), reduce(_replaced, numeric, mailed)).otherwise(mailed)


def redact_email(text: Column) -> Column:
    return redact_type(text, "EMAIL")


def redact_card(text: Column) -> Column:
    return redact_type(text, "CARD")


def redact_ssn(text: Column) -> Column:
    return redact_type(text, "SSN")


def redact_aadhaar(text: Column) -> Column:
    return redact_type(text, "AADHAAR")


def redact_pan(text: Column) -> Column:
    return redact_type(text, "PAN")


def redact_phone(text: Column) -> Column:
    return redact_type(text, "PHONE")


def matches(text: Column, kind: str) -> Column:
    """Number of matches of one PII type."""
    counted = F.regexp_count(text, F.lit(_java(kind)))
    return F.when(_may_match(text, kind), counted).otherwise(0).cast("long")
