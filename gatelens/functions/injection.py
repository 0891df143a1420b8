"""Prompt-injection signals as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens import settings as cfg


def normalize_homoglyphs(text: Column) -> Column:
    """Look-alike letters replaced; texts without a Cyrillic byte are left alone."""
    raw = text.cast("binary")
    cyrillic = F.contains(raw, F.lit(b"\xd0")) | F.contains(raw, F.lit(b"\xd1"))
    return F.when(cyrillic, F.translate(text, cfg.HOMOGLYPHS, cfg.HOMOGLYPH_TARGETS)).otherwise(text)


def _decode_run(run: Column) -> Column:
    """Text of one base64 run; NULL where strict padding rules reject it."""
    body = F.rtrim(run, F.lit("="))
    pads = F.length(run) - F.length(body)
    rest = F.length(body) % 4
    well_padded = (rest == 0) | ((rest == 2) & (pads == 2)) | ((rest == 3) & (pads >= 1))
    raw = F.try_to_binary(body, F.lit("base64"))
    # Undecodable bytes are dropped: they become U+FFFD first.
    decoded = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.when(well_padded, decoded)


def expand_base64(text: Column, min_len: int = cfg.BASE64_MIN_RUN) -> Column:
    """Append the decoded text of every base64-like run of at least ``min_len``."""
    # Listed one by one, the letters compile to a table lookup.  One pass over the
    # text: shorter runs are stepped over whole, never retried from their middle.
    letters = string.ascii_letters + string.digits + "+/"
    run = f"[{letters}]{{{min_len},}}"
    guard = f"^(?:[{letters}]{{0,{min_len - 1}}}+[^{letters}])*+[{letters}]{{{min_len}}}"
    runs = F.regexp_extract_all(text, F.lit(f"({run}={{0,2}})"), F.lit(1))
    decoded = F.filter(
        F.transform(runs, _decode_run), lambda d: F.length(d) > cfg.BASE64_MIN_DECODED
    )
    return F.when(
        F.rlike(text, F.lit(guard)),
        F.concat_ws(" ", text, F.when(F.size(decoded) > 0, F.array_join(decoded, " "))),
    ).otherwise(text)


def scan_text(text: Column) -> Column:
    """What the patterns look at: look-alikes replaced, runs decoded, lower case.

    The two letters that only case folding, not lower-casing, maps to ASCII are
    replaced too, so patterns can be compared without case folding.
    """
    low = F.lower(expand_base64(normalize_homoglyphs(text)))
    return F.replace(F.replace(low, F.lit("\u0131"), F.lit("i")), F.lit("\u017f"), F.lit("s"))


def first_pattern(scanned: Column) -> Column:
    """First matching pattern of an already scanned text; NULL when clean.

    A regular expression only runs on texts that hold the literal it requires.
    """
    label = F.lit(None).cast("string")
    for pattern, required in reversed(cfg.INJECTION_PATTERNS.items()):
        matched = F.contains(scanned, F.lit(required)) & F.rlike(
            scanned, F.lit("(?U)" + pattern.lower())
        )
        label = F.when(matched, F.lit(pattern)).otherwise(label)
    return label
