"""Splitting blocked from clean requests, second-pass redaction, key filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions import entities, pii
from gatelens.functions.injection import first_pattern, scan_text
from gatelens.functions.models import bearer_token, key_preview
from gatelens.functions.once import compute_once


def flag_injection(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pattern``, the first injection pattern of a text; NULL when clean.

    A text is decoded once, however many patterns look at the result.
    """
    scanned = compute_once(df, __scanned=scan_text(F.col(text)))
    return compute_once(scanned, pattern=first_pattern(F.col("__scanned"))).drop("__scanned")


def split_blocked(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocked, clean) by the injection check of the last message."""
    flagged = flag_injection(df, text)
    blocked = flagged.filter(F.col("pattern").isNotNull())
    clean = flagged.filter(F.col("pattern").isNull()).drop("pattern")
    return blocked, clean


def blocked_count(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "injection_blocked").agg(
        F.count(F.lit(1)).alias("blocked_injections")
    )


def pii_type_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Matches and affected texts per PII type.

    All types are counted in one pass and summed before they become rows.
    """
    kinds = pii.ALL_TYPES
    counted = df.select(*[pii.matches(F.col(text), k).alias(k) for k in kinds])
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(f"m_{k}") for k in kinds]
    hits = [F.count_if(F.col(k) > 0).alias(f"t_{k}") for k in kinds]
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("pii_type"),
                F.col(f"m_{k}").alias("matches"),
                F.col(f"t_{k}").alias("texts"),
            )
            for k in kinds
        ]
    )
    return counted.agg(*sums, *hits).select(F.inline(rows))


Entity = tuple[int, int, str, float]  # start, end, type, score


def entity_redact(
    df: DataFrame,
    text: str = "text",
    recogniser: Callable[[], Callable[[list[str]], list[list[Entity]]]] | None = None,
    threshold: float = cfg.ENTITY_SCORE_THRESHOLD,
) -> DataFrame:
    """Both redaction passes: the patterns, then typed entities.

    The types that a pattern can carry are built in, all but names of persons:
    mail and network addresses, phones, cards and accounts (with their check
    digits), social security numbers, passports and driving licences (by the words
    before them).  What overlaps goes as one, under the type of the best score.
    Places are looked up per entity, so a text's cost grows with its length and
    with its number of entities times its length.

    ``recogniser`` is a factory that each Python worker calls once, for a model
    that finds ``(start, end, type, score)`` in each of a list of texts.  Without
    one, or where it fails on a text, the text stays as the patterns left it.
    """
    redacted = compute_once(df, __redacted=pii.redact_pii(F.col(text)))
    first = redacted.withColumn(text, F.col("__redacted")).drop("__redacted")
    kept = F.col(text)
    found = F.when(entities.may_have_entities(kept), entities.entity_spans(kept, threshold))
    spanned = compute_once(first, __spans=found)
    replaced = F.when(F.size("__spans") > 0, entities.replace_spans(kept, F.col("__spans"))).otherwise(kept)
    done = spanned.withColumn(text, replaced).drop("__spans")
    if recogniser is None:
        return done

    def redact_batches(batches: Iterator):
        find = recogniser()
        for batch in batches:
            values = batch[text].tolist()
            found = _found_entities(find, [v or "" for v in values])
            batch[text] = [_replace_entities(v, f, threshold) for v, f in zip(values, found, strict=True)]
            yield batch

    return done.mapInPandas(redact_batches, done.schema)


def _found_entities(find, texts: list[str]) -> list[list[Entity]]:
    """Entities of each text; a list that fails is tried text by text."""
    try:
        return find(texts)
    except Exception:
        return [found for t in texts for found in _found_entities(find, [t])] if len(texts) > 1 else [[]]


def _replace_entities(value: str | None, entities: list[Entity], threshold: float) -> str | None:
    found = [e for e in entities if e[3] >= threshold and e[2] in cfg.ENTITY_TYPES] if value else []
    out, cursor = [], 0
    # Of overlapping entities the surest wins, then the longest.
    kept: list[Entity] = []
    for entity in sorted(found, key=lambda e: (-e[3], e[0] - e[1])):
        if all(entity[1] <= k[0] or entity[0] >= k[1] for k in kept):
            kept.append(entity)
    for start, end, kind, _ in sorted(kept):
        out += [value[cursor:start], f"[REDACTED_{kind}]"]
        cursor = end
    return value if not kept else "".join([*out, value[cursor:]])


def allowed_keys(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Comma-separated allow-list text as one key per row, blanks dropped."""
    return (
        df.select(F.explode(F.split(F.col(raw), ",")).alias("key"))
        .select(F.trim("key").alias("token"))
        .filter("token <> ''")
        .distinct()
    )


def label_api_keys(df: DataFrame, allowed: DataFrame | None, header: str = "header") -> DataFrame:
    """Add ``token``, ``key_preview`` and ``reason``, which is NULL for a usable key.

    Without an allow-list, and with one that is empty, any key may be used.
    """
    given = F.when(F.coalesce(F.col(header), F.lit("")) != "", bearer_token(F.col(header)))
    keyed = df.withColumn("token", given)
    if allowed is None:
        unlisted = F.lit(False)
    else:
        names = allowed.select(F.col("token").alias("__listed")).distinct()
        keyed = keyed.join(names, F.col("token") == F.col("__listed"), "left")
        is_open = allowed.agg(F.count(F.lit(1)) == 0).scalar()
        unlisted = F.col("__listed").isNull() & ~is_open
    reason = F.when(F.col("token").isNull(), "missing key").when(unlisted, "invalid key")
    labelled = keyed.withColumn("reason", reason).withColumn("key_preview", key_preview(F.col("token")))
    return labelled.drop("__listed")


def filter_api_keys(df: DataFrame, allowed: DataFrame | None, header: str = "header") -> DataFrame:
    """Requests with a usable key."""
    return label_api_keys(df, allowed, header).filter(F.col("reason").isNull()).drop("reason")


def rejected_api_keys(df: DataFrame, allowed: DataFrame | None, header: str = "header") -> DataFrame:
    """The requests ``filter_api_keys`` leaves out, with the reason."""
    return label_api_keys(df, allowed, header).filter(F.col("reason").isNotNull()).drop("key_preview")
