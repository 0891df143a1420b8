"""Enriching a stream of raw chat requests, without any state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.messages import last_message, message_text
from gatelens.functions.pii import redact_pii
from gatelens.functions.scoring import heuristic_score
from gatelens.operators.cache import with_cache_key
from gatelens.operators.embed import embed
from gatelens.operators.routing import ambiguous, decide_route, label_open, sample_exemplars
from gatelens.operators.security import flag_injection
from gatelens.sources.requests import parse_all


def stream_enrich(raw: DataFrame, exemplars: DataFrame | None = None) -> DataFrame:
    """(request_id, api_key, json) -> checked, redacted, keyed, classified and routed requests.

    The same column expressions as in batch.  Rejected and blocked requests stay
    in the stream, told apart by ``outcome``.  Prompts whose score is open are
    embedded and compared with ``exemplars`` (kind, vector), a static table, or
    with the built-in samples; its two centroids are taken once per micro-batch.
    """
    parsed = parse_all(raw, "json")
    last = message_text(last_message(F.col("request")["messages"])["content"])
    flagged = flag_injection(parsed.withColumn("text", last), "text")
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("pattern").isNotNull(), "blocked")
        .otherwise("accepted")
    )
    redacted = flagged.withColumn("outcome", outcome).withColumn("prompt", redact_pii(F.col("text")))
    keyed = with_cache_key(redacted).withColumn("score", heuristic_score(F.col("prompt")))
    accepted = F.col("outcome") == "accepted"
    # Texts that are not asked about are NULL, which costs nothing to embed.
    opened = keyed.withColumn("__open", F.when(accepted & ambiguous(F.col("score")), F.col("prompt")))
    if exemplars is None:
        exemplars = sample_exemplars(raw.sparkSession)
    routed = decide_route(label_open(embed(opened, "__open", out="__vec"), "__vec", exemplars))
    kept = ("prompt", "prompt_hash", "score", "label", "target_model", "strategy")
    return routed.select(
        "request_id", "outcome", "pattern", *[F.when(accepted, F.col(c)).alias(c) for c in kept]
    )
