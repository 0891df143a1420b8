"""Rules on model names, keys, prices and log labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens import settings as cfg


def provider_of(model: Column) -> Column:
    """Provider by substring, first match wins; NULL where no model is set."""
    named = reduce(
        lambda acc, rule: F.when(F.contains(model, F.lit(rule[0])), F.lit(rule[1])).otherwise(acc),
        reversed(cfg.PROVIDER_BY_SUBSTRING),
        F.lit(cfg.DEFAULT_PROVIDER),
    )
    return F.when(F.coalesce(model, F.lit("")).isin("none", ""), F.lit(None)).otherwise(named)


def fallback_model(provider: Column, status: Column, model: Column) -> Column:
    """A model the Gemini endpoint does not know is replaced by its default."""
    return F.when(
        (provider == "gemini") & (status == 404), F.lit(cfg.FALLBACK_404_MODEL)
    ).otherwise(model)


def usable_key(key: Column) -> Column:
    """Not empty and not one of the placeholders of an example file."""
    placeholder = reduce(
        lambda acc, p: acc | F.contains(key, F.lit(p)), cfg.PLACEHOLDER_KEYS, F.lit(False)
    )
    return F.coalesce((key != "") & ~placeholder, F.lit(False))


def baseline_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """What the baseline model would have charged for the same tokens."""
    price_in, price_out = cfg.PRICES[cfg.BASELINE_MODEL]
    return (prompt_tokens * F.lit(price_in) + completion_tokens * F.lit(price_out)) / F.lit(1e6)


def roi_percent(actual: Column, strong: Column) -> Column:
    return F.when(strong == 0, F.lit(0.0)).otherwise((strong - actual) / strong * F.lit(100.0))


def status_label(cached: Column, model: Column) -> Column:
    return (
        F.when(cached, F.lit("Cache Hit"))
        .when(F.contains(F.lower(model), F.lit("llama")), F.lit("95% Saved"))
        .otherwise(F.lit("Quality Priority"))
    )


def status_color(cached: Column, model: Column) -> Column:
    return (
        F.when(cached, F.lit("blue"))
        .when(F.contains(F.lower(model), F.lit("llama")), F.lit("teal"))
        .otherwise(F.lit("slate"))
    )


def bearer_token(header: Column) -> Column:
    return F.regexp_replace(header, "^Bearer ", "")


def key_preview(token: Column) -> Column:
    """What of a key may appear in an audit log."""
    return F.concat(F.substring(token, 1, cfg.KEY_PREVIEW_CHARS), F.lit("..."))


def exact_sum(cost: Column) -> Column:
    """A sum of costs that does not depend on the order of the rows."""
    return F.sum(cost.try_cast("decimal(30,12)")).cast("double")
