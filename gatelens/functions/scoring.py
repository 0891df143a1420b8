"""Heuristic complexity score of a prompt."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.text import has_words


def _when(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def keyword_score(text: Column) -> Column:
    """Each keyword counts once, wherever it is contained (also inside words)."""
    low = F.lower(text)
    weighted = [(k, cfg.HIGH_WEIGHT) for k in cfg.HIGH_KEYWORDS]
    weighted += [(k, cfg.LOW_WEIGHT) for k in cfg.LOW_KEYWORDS]
    return reduce(add, [_when(F.contains(low, F.lit(k)), w) for k, w in weighted])


def length_score(text: Column) -> Column:
    return F.when(~has_words(text, 8), F.lit(-1)).when(has_words(text, 151), F.lit(1)).otherwise(F.lit(0))


def structure_score(text: Column) -> Column:
    return (
        _when(F.contains(text, F.lit("{")) & F.contains(text, F.lit("}")), 2)
        + _when(F.contains(text, F.lit("```")), 2)
        + _when(F.contains(text, F.lit("?")) & ~has_words(text, 15), -1)
    )


def heuristic_score(text: Column) -> Column:
    return keyword_score(text) + length_score(text) + structure_score(text)
