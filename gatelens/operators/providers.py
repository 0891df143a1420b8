"""Bringing the two provider formats to one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.messages import message_text
from gatelens.operators.logs import usage

_STRIP = "^[\\s\\x{1c}-\\x{1f}]+|[\\s\\x{1c}-\\x{1f}]+$"


def _stop_list(stop: Column) -> Column:
    listed = F.try_variant_get(stop, "$", "array<string>")
    single = F.try_variant_get(stop, "$", "string")
    is_list = F.startswith(F.schema_of_variant(stop), F.lit("ARRAY"))
    return F.when(is_list, F.when(F.size(listed) > 0, listed)).otherwise(
        F.when(single != "", F.array(single))
    )


def normalize_request(df: DataFrame) -> DataFrame:
    """Completion requests as messages-format requests.

    System texts move to the top level, other messages stay in order.
    """
    is_system = lambda m: m["role"] == "system"
    system = F.regexp_replace(
        F.array_join(
            F.transform(F.filter("messages", is_system), lambda m: message_text(m["content"])), "\n"
        ),
        _STRIP,
        "",
    )
    drop = {"messages", "model", "max_tokens", "temperature", "top_p", "stop"}
    return df.select(
        *[c for c in df.columns if c not in drop],
        F.coalesce(F.col("model"), F.lit(cfg.DEFAULT_MESSAGES_MODEL)).alias("model"),
        F.transform(
            F.filter("messages", lambda m: m["role"] != "system"),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages"),
        F.coalesce(F.col("max_tokens"), F.lit(cfg.DEFAULT_MAX_TOKENS)).alias("max_tokens"),
        F.when(system != "", system).alias("system"),
        "temperature",
        "top_p",
        _stop_list(F.col("stop")).alias("stop_sequences"),
    )


def normalize_response(df: DataFrame) -> DataFrame:
    """Messages-format responses as completion responses."""
    texts = F.filter("content", lambda b: F.coalesce(b["type"] == "text", F.lit(False)))
    text = F.array_join(F.transform(texts, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    tokens_in = F.coalesce(F.col("usage.input_tokens"), F.lit(0)).cast("long")
    tokens_out = F.coalesce(F.col("usage.output_tokens"), F.lit(0)).cast("long")
    drop = {"id", "content", "usage", "stop_reason", "model"}
    message = F.struct(
        F.lit("assistant").alias("role"), F.coalesce(text, F.lit("")).alias("content")
    )
    choice = F.struct(
        F.lit(0).alias("index"),
        message.alias("message"),
        F.coalesce(F.col("stop_reason"), F.lit("stop")).alias("finish_reason"),
    )
    return df.select(
        *[c for c in df.columns if c not in drop],
        F.coalesce(F.col("id"), F.lit("msg_unknown")).alias("id"),
        F.lit("chat.completion").alias("object"),
        F.lit(0).cast("long").alias("created"),
        "model",
        F.array(choice).alias("choices"),
        F.struct(
            tokens_in.alias("prompt_tokens"),
            tokens_out.alias("completion_tokens"),
            (tokens_in + tokens_out).alias("total_tokens"),
        ).alias("usage"),
    )


def unify_usage(*responses: DataFrame) -> DataFrame:
    """One usage table (id, model, tokens) out of responses of any provider."""
    parts = [
        r.select("id", "model", usage(F.struct("usage")).alias("u")).select("id", "model", "u.*")
        for r in responses
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
