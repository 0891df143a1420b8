"""Turning completions into log rows and blocked requests into event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.pii import redact_pii
from gatelens.functions.text import preview
from gatelens.sources.tables import ID_BUCKETS, REQUEST_LOGS, SECURITY_EVENTS, append_batch, id_table, typed


def usage(response: Column) -> Column:
    """Token counts of a response, 0 where absent."""

    def tokens(name: str) -> Column:
        return F.coalesce(response["usage"][name], F.lit(0)).cast("long").alias(name)

    return F.struct(tokens("prompt_tokens"), tokens("completion_tokens"), tokens("total_tokens"))


def request_rows(completions: DataFrame, cached_cost: str = "logged") -> DataFrame:
    """Completions as log rows, with the defaults of the log.

    Cached rows cost what their answer did, or nothing with ``cached_cost`` "zero".
    """

    def or_default(column: str, default) -> Column:
        return F.coalesce(F.col(column), F.lit(default))

    free = or_default("cached", False) & F.lit(cached_cost == "zero")
    counted = completions.withColumn("u", usage(F.struct("usage")))
    return typed(
        counted.select(
            "id",
            "timestamp",
            "model",
            or_default("provider", cfg.DEFAULT_PROVIDER).alias("provider"),
            "u.prompt_tokens",
            "u.completion_tokens",
            "u.total_tokens",
            F.when(free, F.lit(0.0)).otherwise(or_default("estimated_cost", 0.0)).alias("cost"),
            or_default("strategy", "direct").alias("strategy"),
            or_default("latency_ms", 0).alias("latency_ms"),
            or_default("cached", False).alias("cached"),
            or_default("optimized", True).alias("optimized"),
        ),
        REQUEST_LOGS,
    )


def first_per_id(rows: DataFrame) -> DataFrame:
    """The earliest row of every id.

    An aggregate rather than a window: copies of one id collapse before the
    shuffle, so an id repeated a billion times is not sorted in one task.
    """
    others = [c for c in rows.columns if c not in ("id", "timestamp")]
    first = F.min_by(F.struct("timestamp", *others), F.struct(F.col("timestamp"), F.xxhash64(*others)))
    return rows.groupBy("id").agg(first.alias("r")).select("id", "r.*").select(*rows.columns)


def append_requests(new: DataFrame, existing: DataFrame, cached_cost: str = "logged") -> DataFrame:
    """The log rows to insert: one per id, ids already logged left out.

    The log is first reduced to the ids that come again.  The new ids are the
    hashed side of that join, so old ones pass by without being sorted; as an
    ``id_table``, which is bucketed, they are not shuffled either.
    """
    rows = first_per_id(request_rows(new, cached_cost))
    seen = existing.select("id").join(rows.select("id").hint("shuffle_hash"), "id", "left_semi")
    return rows.join(seen, "id", "left_anti").select(*REQUEST_LOGS.fieldNames())


def append_log_batch(new: DataFrame, path: str, ids_path: str, batch_id: int, buckets: int = ID_BUCKETS) -> DataFrame:
    """Log a batch of completions whose ids are not logged yet; returns the rows written."""
    known = id_table(new.sparkSession, ids_path, buckets)
    return append_batch(append_requests(new, known), path, ids_path, batch_id, buckets)


def event_id(request_id: Column, event_type: Column) -> Column:
    """A 60-bit id out of request and event type: the same on every re-run."""
    digest = F.sha2(F.concat(request_id.cast("string"), F.lit(":"), event_type), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def security_event_rows(
    blocked: DataFrame, event_type: str = "injection_blocked", redact: bool = True
) -> DataFrame:
    """Events out of blocked requests (request_id, timestamp, text, pattern, source_ip).

    Previews show redacted text, unless ``redact`` is off.
    """
    kind = F.lit(event_type)
    text = redact_pii(F.col("text")) if redact else F.col("text")
    return typed(
        blocked.select(
            event_id(F.col("request_id"), kind).alias("id"),
            "timestamp",
            kind.alias("event_type"),
            F.col("pattern").alias("pattern_matched"),
            preview(text, cfg.EVENT_PREVIEW_CHARS).alias("prompt_preview"),
            "source_ip",
        ),
        SECURITY_EVENTS,
    )
