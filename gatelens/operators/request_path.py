"""The whole request path over a table of raw bodies: check, redact, look up, route, price."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.messages import last_message, message_text
from gatelens.functions.models import provider_of
from gatelens.functions.once import compute_once
from gatelens.functions.pii import redact_pii
from gatelens.functions.scoring import heuristic_score
from gatelens.operators.cache import cache_hit_rows, seconds, tiered_lookup, with_cache_key
from gatelens.operators.cost import with_cost
from gatelens.operators.embed import embed
from gatelens.operators.logs import request_rows, security_event_rows
from gatelens.operators.routing import decide_route, label_open, sample_exemplars
from gatelens.operators.security import flag_injection
from gatelens.session import work_table
from gatelens.sources.requests import parse_all


def checked_requests(raw: DataFrame) -> DataFrame:
    """Add ``prompt`` (the redacted last message) and ``stopped``: why a request goes no further, or NULL."""
    parsed = parse_all(raw, "json")
    last = message_text(last_message(F.col("request")["messages"])["content"])
    flagged = flag_injection(parsed.withColumn("text", last), "text")
    stopped = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("pattern").isNotNull(), "blocked")
    return compute_once(flagged, stopped=stopped, prompt=redact_pii(F.col("text"))).drop("text", "request")


def prompt_index(writes: DataFrame, encoder=None) -> DataFrame:
    """(seq, tenant, prompt_hash, vector) of cache writes, by their normalized prompts."""
    vectors = embed(writes.select("seq", "tenant_salt", "prompt_hash", "normalized"), "normalized", encoder)
    return vectors.select("seq", F.col("tenant_salt").alias("tenant"), "prompt_hash", "vector")


class Served(NamedTuple):
    """What a batch of requests gives, and what is to be written before the next one."""

    outcomes: DataFrame  # one row per request: outcome, pattern, model, provider, strategy, cost
    log_rows: DataFrame  # answered requests, as ``sources.tables.REQUEST_LOGS``
    fills: DataFrame  # answered misses as cache entries, for ``cache.upsert_cache``
    index_rows: DataFrame  # their vectors (seq, tenant, prompt_hash, vector)
    events: DataFrame  # blocked requests, as ``sources.tables.SECURITY_EVENTS``


def serve_requests(
    raw: DataFrame,
    cache: DataFrame,
    index: DataFrame,
    answers: DataFrame,
    cached_cost: str = "logged",
    encoder=None,
    threshold: float = cfg.SIMILARITY_THRESHOLD,
    exemplars: DataFrame | None = None,
) -> Served:
    """The request path over a batch, to its end.

    ``raw`` holds (request_id, arrival, api_key, json [, source_ip]), ``cache`` one
    row per hash, ``index`` what ``prompt_index`` makes.  ``answers`` (request_id,
    model, prompt_tokens, completion_tokens [, latency_ms]) is what providers made
    of the misses; its model, which a fail-over may have chosen, is the one that is
    priced.  A hit costs what its answer did, or nothing with ``cached_cost``
    "zero".  A miss without an answer is neither logged nor cached.

    Bodies are parsed and checked once, only requests that the exact tier missed
    are embedded, and their vectors serve the search, the classifier of open scores
    (against ``exemplars`` (kind, vector), or the built-in samples) and the index.
    Both steps are kept in work tables.  A batch sees the cache as it was before;
    ``operators.replay`` tells what requests within one batch would find.
    """
    spark, given = raw.sparkSession, [c for c in ("source_ip",) if c in raw.columns]
    checked = checked_requests(raw).select("request_id", "arrival", "api_key", *given, "stopped", "pattern", "prompt")
    keyed = work_table(with_cache_key(checked).withColumn("tenant", F.col("tenant_salt")), "requests")
    asked = keyed.filter(F.col("stopped").isNull()).drop("stopped", "pattern", *given)
    found = tiered_lookup(asked, cache, index, threshold, vectors=lambda d: embed(d, "normalized", encoder))
    scored = found.withColumn("score", heuristic_score(F.col("prompt")))
    exemplars = sample_exemplars(spark, encoder) if exemplars is None else exemplars
    routed = decide_route(label_open(scored, "vector", exemplars))
    took = F.col("latency_ms") if "latency_ms" in answers.columns else F.lit(0)
    usage = answers.select(
        F.col("request_id").alias("__id"),
        F.col("model").alias("__model"),
        *[F.col(c).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")],
        took.cast("long").alias("latency_ms"),
    )
    hit = F.col("tier") != "miss"
    answered = routed.join(usage, F.col("request_id") == F.col("__id"), "left").withColumn(
        "model", F.when(hit, F.col("response.model")).otherwise(F.coalesce("__model", "target_model"))
    )
    spent = F.lit(0.0) if cached_cost == "zero" else F.col("response.estimated_cost")
    done = with_cost(answered).withColumns(
        {
            "strategy": F.when(hit, F.col("response.strategy")).otherwise(F.col("strategy")),
            "cost": F.when(hit, spent).otherwise(F.coalesce("cost", F.lit(0.0))),
            "provider": provider_of(F.col("model")),
            "tokens": _tokens(F.col("prompt_tokens"), F.col("completion_tokens")),
        }
    )
    done = work_table(done.drop("api_key", "prompt", "prompt_tokens", "completion_tokens"), "served")
    stopped = keyed.filter(F.col("stopped").isNotNull())
    nothing = F.lit(None).cast("string")
    outcomes = done.select(
        "request_id", F.col("tier").alias("outcome"), nothing.alias("pattern"), "model", "provider", "strategy", "cost"
    ).unionByName(
        stopped.select("request_id", F.col("stopped").alias("outcome"), "pattern"), allowMissingColumns=True
    )
    missed = done.filter((F.col("tier") == "miss") & F.col("__id").isNotNull())
    fills = _fills(missed, cache)
    seen = F.col("source_ip") if given else nothing
    blocked = stopped.filter(F.col("stopped") == "blocked").select(
        "request_id", F.col("arrival").alias("timestamp"), F.col("prompt").alias("text"), "pattern", seen.alias("source_ip")
    )
    return Served(
        outcomes=outcomes,
        log_rows=request_rows(_hit_completions(done).unionByName(_completions(missed))),
        fills=fills,
        index_rows=missed.select(F.col("request_id").alias("seq"), "tenant", "prompt_hash", "vector"),
        events=security_event_rows(blocked, redact=False),  # the prompt is redacted already
    )


def process_requests(*args, **kwargs) -> DataFrame:
    """The outcomes of ``serve_requests``."""
    return serve_requests(*args, **kwargs).outcomes


def _tokens(prompt: Column, completion: Column) -> Column:
    total = F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))
    return F.struct(
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens")
    )


def _completions(missed: DataFrame) -> DataFrame:
    """Answered misses as completions to be logged."""
    return missed.select(
        F.col("request_id").cast("string").alias("id"),
        F.col("arrival").alias("timestamp"),
        "model",
        "provider",
        F.col("tokens").alias("usage"),
        F.col("cost").alias("estimated_cost"),
        "strategy",
        "latency_ms",
        F.lit(False).alias("cached"),
        F.lit(True).alias("optimized"),
    )


def _hit_completions(done: DataFrame) -> DataFrame:
    """Hits as completions to be logged, with the usage of the answer they repeat, where that is known."""
    hits = done.filter(F.col("tier") != "miss")
    known = "usage" in hits.schema["response"].dataType.names
    old = [F.col("response.usage")[c] if known else F.lit(None) for c in ("prompt_tokens", "completion_tokens")]
    usage = _tokens(*[c.cast("long") for c in old])
    response = F.struct("model", usage.alias("usage"), F.col("cost").alias("estimated_cost"), "strategy")
    rows = hits.select("request_id", "arrival", response.alias("response"), "provider", F.lit(0).alias("lookup_ms"))
    return cache_hit_rows(rows)


def _fills(missed: DataFrame, cache: DataFrame) -> DataFrame:
    """Answered misses with the columns of ``cache``, alive from the moment they were answered."""
    usage = F.col("tokens")
    known = {"model": F.col("model"), "provider": F.col("provider"), "usage": usage, "strategy": F.col("strategy")}
    known |= {"estimated_cost": F.col("cost"), "latency_ms": F.col("latency_ms")}
    response = F.struct(
        *[
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in cache.schema["response"].dataType
        ]
    )
    answered_at = F.col("arrival") + seconds(F.coalesce("latency_ms", F.lit(0)) / 1000)
    filled = missed.select(
        "prompt_hash",
        "tenant_salt",
        "normalized",
        answered_at.alias("stored_at"),
        (answered_at + seconds(cfg.CACHE_TTL_S)).alias("expires_at"),
        F.col("request_id").alias("seq"),
        response.alias("response"),
    )
    return filled.select(*[c for c in cache.columns if c in filled.columns])
