"""Typed entities of the second redaction pass: patterns, check digits, context and overlaps, as columns.

A rule's matches are told by splitting the text at them, so that their places
follow from the lengths of what lies between, and the characters around a match
are the ends of its neighbours.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.once import let

_SPAN = "array<struct<start:int,end:int,rank:struct<score:double,length:int,early:int,rule:int,kind:string>>>"


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    places = F.split(F.reverse(digits), "")

    def weighed(d: Column, i: Column) -> Column:
        twice = 2 * d.cast("int")
        return F.when(i % 2 == 0, d.cast("int")).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(places, weighed), F.lit(0), lambda acc, x: acc + x)
    return total % 10 == 0


def iban_valid(code: Column) -> Column:
    """Whether an account code without blanks, of letters A-Z and digits, is 1 modulo 97."""
    turned = F.split(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4)), "")

    def add(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return (acc * F.when(digit, 10).otherwise(100) + F.ascii(c) - F.when(digit, 48).otherwise(55)) % 97

    return F.aggregate(turned, F.lit(0), add) == 1


def ssn_possible(digits: Column) -> Column:
    """Whether nine digits may be a social security number: no area 000, 666 or 9xx, no part all zero."""
    return ~F.rlike(digits, F.lit("^(?:000|666|9)|^...00|0000$"))


def _iban_part(hit: Column) -> Column:
    """The longest valid code among a match and the match without its last one or two groups, or NULL."""
    cut = lambda c: F.regexp_replace(c, F.lit(" [A-Z0-9]{1,4}$"), F.lit(""))
    valid = lambda c: F.when(iban_valid(F.regexp_replace(c, F.lit(" "), F.lit(""))), c)
    return let(cut(hit), lambda shorter: F.coalesce(valid(hit), valid(shorter), valid(cut(shorter))))


def _checked(hit: Column, check: str | None) -> Column:
    """What of a match passes the check of its rule, or NULL."""
    digits = F.regexp_replace(hit, F.lit("[^0-9]"), F.lit(""))
    if check == "luhn":
        return F.when(luhn_valid(digits), hit)
    if check == "iban":
        return _iban_part(hit)
    return F.when(ssn_possible(digits), hit) if check == "ssn" else hit


def _candidates(text: Column, rule: int, threshold: float) -> Column:
    """The matches of one rule that reach the threshold, as ``_SPAN``."""
    kind, pattern, score, check, words = cfg.ENTITY_RULES[rule]
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    beside = F.lit(r"[\p{L}\p{N}_]")
    sure = 1.0 if check in ("luhn", "iban") else score
    boosted = min(1.0, max(sure + cfg.ENTITY_CONTEXT_BOOST, cfg.ENTITY_SCORE_THRESHOLD))

    def starts(v: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            F.arrays_zip(v["hits"].alias("hit"), F.slice(v["gaps"], 1, F.size(v["hits"])).alias("gap")),
            first,
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
                F.concat(acc["starts"], F.array(acc["at"] + F.length(p["gap"]))).alias("starts"),
            ),
        )["starts"]

    def spans(v: Column) -> Column:
        def span(start: Column, i: Column) -> Column:
            before, after = F.get(v["gaps"], i), F.get(v["gaps"], i + 1)
            alone = ~F.rlike(F.right(before, F.lit(1)), beside) & ~F.rlike(F.left(after, F.lit(1)), beside)
            alone &= ((i == 0) | (before != "")) & ((i == F.size(v["hits"]) - 1) | (after != ""))
            near = F.lower(F.right(before, F.lit(cfg.ENTITY_CONTEXT_CHARS)))
            spoken = reduce(or_, [F.contains(near, F.lit(w)) for w in words], F.lit(False))
            points = F.when(spoken, F.lit(boosted)).otherwise(F.lit(sure))
            size = F.length(F.when(alone, _checked(F.get(v["hits"], i), check)))
            return let(size, lambda n: _span(start, n, points, rule, kind))

        return F.transform(starts(v), span)

    reached = lambda s: s["end"].isNotNull() & (s["rank"]["score"] >= threshold)
    none = F.array().cast(_SPAN)
    # Most rules find nothing in most texts, and the gaps need a second search.
    beyond = lambda h: F.filter(let(F.struct(h.alias("hits"), gaps.alias("gaps")), spans), reached).cast(_SPAN)
    found = let(hits, lambda h: F.when(F.size(h) > 0, beyond(h)).otherwise(none))
    possible = F.contains(text, F.lit("@")) if "@" in pattern else F.lit(True)
    return F.when(possible, found).otherwise(none)


def _span(start: Column, length: Column, points: Column, rule: int, kind: str) -> Column:
    rank = F.struct(
        points.alias("score"), length.alias("length"), (-start).alias("early"), F.lit(-rule).alias("rule"), F.lit(kind).alias("kind")
    )
    return F.struct(start.alias("start"), (start + length).alias("end"), rank.alias("rank"))


def entity_spans(text: Column, threshold: float = cfg.ENTITY_SCORE_THRESHOLD) -> Column:
    """Every (start, end, rank) of a text that is to be redacted, in order and apart.

    Matches that overlap are one span, which covers them all and bears the type of
    the best: by score, then length, then place, then the order of the rules.
    """
    found = [_candidates(text, i, threshold) for i in range(len(cfg.ENTITY_RULES))]

    def merge(acc: Column, span: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], span["end"]).alias("end"),
            F.greatest(last["rank"], span["rank"]).alias("rank"),
        )
        apart = (F.size(acc) == 0) | (last["end"] <= span["start"])
        return F.when(apart, F.concat(acc, F.array(span))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
        )

    return F.aggregate(F.array_sort(F.concat(*found)), F.array().cast(_SPAN), merge)


def may_have_entities(text: Column) -> Column:
    """Cheap necessary condition: an ``@``, or a digit."""
    return F.rlike(text, F.lit("[0-9@]"))


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with ``[REDACTED_<TYPE>]`` in place of each span."""

    def replaced(found: Column) -> Column:
        end_of = lambda i: F.coalesce(F.get(found, i)["end"], F.lit(0))
        pieces = F.transform(
            found,
            lambda s, i: F.concat(
                F.substring(text, end_of(i - 1) + 1, s["start"] - end_of(i - 1)),
                F.lit("[REDACTED_"), s["rank"]["kind"], F.lit("]"),
            ),
        )
        rest = F.substring(text, end_of(F.size(found) - 1) + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), rest)

    return let(spans, replaced)
