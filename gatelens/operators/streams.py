"""Assembling streamed answers and replaying cached ones as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.once import compute_once
from gatelens.functions.sse import DONE, sse_delta
from gatelens.functions.text import token_count
from gatelens.operators.cost import with_cost


def deltas(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, delta) of the lines that carry text."""
    parsed = compute_once(lines.select("stream_id", "seq", "line"), delta=sse_delta(F.col("line")))
    return parsed.filter(F.col("delta").isNotNull()).drop("line")


def assemble_streams(parts: DataFrame) -> DataFrame:
    """Full text per stream, in the order of ``seq``; streams without text drop out.

    A stream is one model answer, so its size is bounded by the model's output
    limit.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    text = F.array_join(F.transform(ordered, lambda p: p["delta"]), "")
    return (
        parts.filter(F.coalesce("delta", F.lit("")) != "")
        .groupBy("stream_id")
        .agg(text.alias("text"))
    )


def stream_records(streams: DataFrame, price_table: DataFrame | None = None,
                   ranks: str | None = None) -> DataFrame:
    """Log records of finished streams (stream_id, text, prompt, model, strategy, latency_ms).

    The log keeps a preview of the answer; ``text`` stays whole for the cache.
    """
    counted = (
        streams.withColumn("prompt_tokens", token_count(F.col("prompt"), ranks))
        .withColumn("completion_tokens", token_count(F.col("text"), ranks))
        .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    )
    return with_cost(counted, price_table).select(
        F.concat(F.lit("stream-"), F.col("stream_id").cast("string")).alias("id"),
        "model",
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        F.col("cost").alias("estimated_cost"),
        "strategy",
        "latency_ms",
        F.lit(False).alias("cached"),
        F.lit(True).alias("optimized"),
        F.concat(F.substring("text", 1, cfg.STREAM_PREVIEW_CHARS), F.lit("...")).alias("content"),
        "text",
    )


def _chunks(text: Column, words: int) -> Column:
    parts = F.split(text, " ")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1, F.lit(words)),
        lambda i: F.concat(
            F.array_join(F.slice(parts, i + 1, F.lit(words)), " "),
            F.when(i + words < F.size(parts), F.lit(" ")).otherwise(F.lit("")),
        ),
    )


def rechunk(df: DataFrame, text: str = "text", words: int = cfg.CACHED_CHUNK_WORDS) -> DataFrame:
    """Cached text as chunks of ``words`` words; all but the last end in a blank."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(_chunks(F.col(text), words)).alias("chunk_no", "chunk"))


def replay_lines(answers: DataFrame, words: int = cfg.CACHED_CHUNK_WORDS) -> DataFrame:
    """(stream_id, seq, line): cached answers as the event lines a client that streams is sent.

    ``answers`` holds (stream_id, created, model, text); ``created`` is in seconds.
    Every line of an answer bears one id, made of ``stream_id``, so that it is the
    same on every re-run; the last line says that the answer is done.  A null text
    is an empty one.
    """
    lines = F.concat(_chunks(F.coalesce("text", F.lit("")), words), F.array(F.lit(None).cast("string")))
    parts = answers.select("stream_id", "created", "model", F.posexplode(lines).alias("seq", "__chunk"))
    choice = F.struct(
        F.lit(0).alias("index"),
        F.struct(F.col("__chunk").alias("content")).alias("delta"),
        F.lit(None).cast("string").alias("finish_reason"),
    )
    event = F.struct(
        F.concat(F.lit("chatcmpl-"), F.col("stream_id").cast("string")).alias("id"),
        F.lit("chat.completion.chunk").alias("object"),
        "created",
        F.coalesce("model", F.lit("cached-model")).alias("model"),
        F.array(choice).alias("choices"),
    )
    sent = F.concat(F.lit("data: "), F.to_json(event, {"ignoreNullFields": "false"}))
    return parts.select("stream_id", "seq", F.when(F.col("__chunk").isNull(), F.lit(DONE)).otherwise(sent).alias("line"))
