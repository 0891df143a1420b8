"""Queries over routing scores, decisions and fail-over."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions import scoring
from gatelens.functions.models import fallback_model, provider_of
from gatelens.operators import routing
from gatelens.plans import fixtures as fx
from gatelens.plans.cache import embed_sql
from gatelens.plans.fixture_sql import CTES, quote, with_ctes

STRONG = "gpt-4o"


def _scored(score):
    def query(spark, sf):
        return fx.routing_texts(spark, sf).select("doc_id", score(F.col("text")).alias("score"))

    return query


def _similar(spark, sf):
    index = fx.vector_index(spark, sf).select("seq", "vector")
    return routing.exemplar_similarity(index, "vector", fx.exemplars(spark, sf))


def route_exemplar_similarity(spark, sf):
    return _similar(spark, sf).select(
        F.col("seq").alias("vec_id"),
        F.round("avg_complex", 6).alias("avg_complex"),
        F.round("avg_trivial", 6).alias("avg_trivial"),
        "label",
    )


def route_decide(spark, sf):
    """Texts with a stored vector are classified by it, the others have no classifier."""
    scored = fx.routing_texts(spark, sf).select(
        "doc_id", "tenant", scoring.heuristic_score(F.col("text")).alias("score")
    )
    labels = _similar(spark, sf).select(F.col("seq").alias("doc_id"), "label")
    decided = routing.decide_route(scored.join(labels, "doc_id", "left"))
    return decided.select("doc_id", "score", "label", "target_model", "strategy")


def route_prompts(spark, sf):
    routed = routing.route_prompts(fx.routing_texts(spark, sf), "text")
    return routed.select("doc_id", "score", "label", "target_model", "strategy")


def route_model_pair(spark, sf):
    return routing.model_pair(fx.provider_keys(spark, sf))


def provider_of_model(spark, sf):
    return routing.with_provider(fx.requested_models(spark, sf))


def failover_resolve(spark, sf):
    return routing.resolve_attempts(fx.attempts(spark, sf), STRONG)


def stream_failover_resolve(spark, sf):
    return routing.resolve_streams(
        fx.attempts(spark, sf, streamed=True), fx.attempt_chunks(spark, sf), STRONG
    )


def model_404_fallback(spark, sf):
    tried = fx.requested_models(spark, sf).join(
        fx.attempts(spark, sf).filter("attempt_no = 1").select("request_id", "status"), "request_id"
    )
    provider = provider_of(F.col("model"))
    return tried.select(
        "request_id",
        provider.alias("provider"),
        "status",
        fallback_model(provider, F.col("status"), F.col("model")).alias("model"),
    )


QUERIES = {
    "route_keyword_score": _scored(scoring.keyword_score),
    "route_length_score": _scored(scoring.length_score),
    "route_structure_score": _scored(scoring.structure_score),
    "route_heuristic_score": _scored(scoring.heuristic_score),
    **{
        f.__name__: f
        for f in (
            route_exemplar_similarity,
            route_decide,
            route_prompts,
            route_model_pair,
            provider_of_model,
            failover_resolve,
            stream_failover_resolve,
            model_404_fallback,
        )
    },
}

_KEYWORDS = " + ".join(
    f"CASE WHEN contains(lower(text), {quote(k)}) THEN {w} ELSE 0 END"
    for words, w in ((cfg.HIGH_KEYWORDS, cfg.HIGH_WEIGHT), (cfg.LOW_KEYWORDS, cfg.LOW_WEIGHT))
    for k in words
)
_WORDS = r"len(regexp_extract_all(text, '\S+'))"
_LENGTH = f"CASE WHEN {_WORDS} > 150 THEN 1 WHEN {_WORDS} < 8 THEN -1 ELSE 0 END"
_STRUCTURE = f"""(CASE WHEN contains(text, '{{') AND contains(text, '}}') THEN 2 ELSE 0 END
    + CASE WHEN contains(text, '```') THEN 2 ELSE 0 END
    + CASE WHEN contains(text, '?') AND {_WORDS} < 15 THEN -1 ELSE 0 END)"""
CTES["fx_similar"] = """
    SELECT seq AS vec_id, avg(list_cosine_similarity(v.vector, e.vector)) FILTER (e.kind = 'complex') AS avg_complex,
      avg(list_cosine_similarity(v.vector, e.vector)) FILTER (e.kind = 'trivial') AS avg_trivial
    FROM fx_vector_index v, fx_exemplars e GROUP BY seq"""
CTES["fx_scored"] = f"SELECT doc_id, ({_KEYWORDS} + {_LENGTH} + {_STRUCTURE})::INTEGER AS score FROM fx_routing"
_PROVIDER = (
    "CASE WHEN coalesce(model, '') IN ('', 'none') THEN NULL "
    + " ".join(f"WHEN contains(model, '{s}') THEN '{p}'" for s, p in cfg.PROVIDER_BY_SUBSTRING)
    + f" ELSE '{cfg.DEFAULT_PROVIDER}' END"
)
_REQUESTED = """
    SELECT event_id AS request_id, CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'signup' THEN 'gpt-4o'
        WHEN 'view' THEN 'llama-3.1-8b-instant' WHEN 'click' THEN 'gpt-3.5-turbo'
        WHEN 'purchase' THEN 'llama-3.3-70b-versatile' ELSE 'unlisted-model' END
      ELSE ['', 'none', 'claude-3-opus', 'mixtral-8x7b', 'gemini-1.5-pro', 'o1-mini'][(event_id % 6 + 1)::BIGINT] END AS model
    FROM events"""

_SAMPLES = ", ".join(
    f"({i}, '{kind}', {quote(text)})"
    for i, (kind, text) in enumerate(
        [("complex", t) for t in cfg.COMPLEX_EXEMPLARS] + [("trivial", t) for t in cfg.TRIVIAL_EXEMPLARS]
    )
)


def kind_sql(source: str, key: str, text: str) -> str:
    """(key, kind) of the nearer centroid of the sample prompts, for texts that share a feature with one."""
    samples = f"(SELECT * FROM (VALUES {_SAMPLES}) s(sample, kind, text))"
    return f"""
        SELECT e.{key}, CASE WHEN coalesce(sum(e.x * c.x) FILTER (c.kind = 'complex'), 0)
            > coalesce(sum(e.x * c.x) FILTER (c.kind = 'trivial'), 0) THEN 'complex' ELSE 'trivial' END AS kind
        FROM ({embed_sql(source, key, text)}) e JOIN (
          SELECT s.kind, e.bucket, sum(e.x) / any_value(s.n) AS x FROM ({embed_sql(samples, "sample", "text")}) e
          JOIN (SELECT *, count(*) OVER (PARTITION BY kind) AS n FROM {samples}) s ON s.sample = e.sample
          GROUP BY 1, 2) c ON c.bucket = e.bucket GROUP BY 1"""


def label_sql(score: str, kind: str) -> str:
    """The classifier's label of an open score."""
    return f"CASE WHEN {score} > {cfg.LEAN_SCORE} AND {score} < {cfg.STRONG_SCORE} THEN coalesce({kind}, 'trivial') END"


def strong_sql(score: str, label: str) -> str:
    """Whether the strong model is chosen, where every open score has a label."""
    return f"coalesce({label} = 'complex', {score} >= {cfg.STRONG_SCORE})"


SQL = {
    "route_keyword_score": f"SELECT doc_id, ({_KEYWORDS})::INTEGER AS score FROM fx_routing",
    "route_length_score": f"SELECT doc_id, ({_LENGTH})::INTEGER AS score FROM fx_routing",
    "route_structure_score": f"SELECT doc_id, ({_STRUCTURE})::INTEGER AS score FROM fx_routing",
    "route_heuristic_score": "SELECT doc_id, score FROM fx_scored",
    "route_exemplar_similarity": """
        SELECT vec_id, round(avg_complex, 6) AS avg_complex, round(avg_trivial, 6) AS avg_trivial,
          CASE WHEN avg_complex > avg_trivial THEN 'complex' ELSE 'trivial' END AS label FROM fx_similar""",
    "route_decide": f"""
        SELECT doc_id, score, label,
          CASE WHEN c = 'complex' OR (c IS NULL AND score >= {cfg.FALLBACK_STRONG_SCORE}) THEN 'gpt-4o' ELSE 'gpt-3.5-turbo' END AS target_model,
          CASE c WHEN 'complex' THEN 'intensive_reasoning' WHEN 'trivial' THEN 'efficiency_optimized' ELSE 'balanced_performance' END AS strategy
        FROM (SELECT *, CASE WHEN score >= {cfg.STRONG_SCORE} THEN 'complex' WHEN score <= {cfg.LEAN_SCORE} THEN 'trivial' ELSE label END AS c FROM (
          SELECT s.doc_id, s.score, CASE WHEN v.vec_id IS NULL THEN NULL
            WHEN v.avg_complex > v.avg_trivial THEN 'complex' ELSE 'trivial' END AS label
          FROM fx_scored s LEFT JOIN fx_similar v ON v.vec_id = s.doc_id))""",
    "route_prompts": f"""
        WITH labelled AS (SELECT s.doc_id, s.score, {label_sql("s.score", "n.kind")} AS label
          FROM fx_scored s LEFT JOIN ({kind_sql("fx_routing", "doc_id", "text")}) n ON n.doc_id = s.doc_id)
        SELECT doc_id, score, label, CASE WHEN {strong_sql("score", "label")} THEN 'gpt-4o' ELSE 'gpt-3.5-turbo' END AS target_model,
          CASE WHEN {strong_sql("score", "label")} THEN 'intensive_reasoning' ELSE 'efficiency_optimized' END AS strategy
        FROM labelled""",
    "route_model_pair": """
        SELECT user_id AS tenant,
          CASE WHEN user_id % 4 = 0 THEN 'gpt-3.5-turbo' WHEN user_id % 3 = 0 THEN 'llama-3.1-8b-instant'
            WHEN user_id % 5 <> 0 THEN 'gemini-1.5-flash' ELSE 'none' END AS lean_model,
          CASE WHEN user_id % 4 = 0 THEN 'gpt-4o' WHEN user_id % 3 = 0 THEN 'llama-3.3-70b-versatile'
            WHEN user_id % 5 <> 0 THEN 'gemini-1.5-pro' ELSE 'none' END AS strong_model
        FROM (SELECT DISTINCT user_id FROM events)""",
    "provider_of_model": f"""
        SELECT *, CASE WHEN provider IS NULL THEN 'no valid api keys' END AS error FROM (
          SELECT request_id, model, {_PROVIDER} AS provider FROM ({_REQUESTED}))""",
    "failover_resolve": """
        SELECT request_id, CASE WHEN esc THEN 'gpt-4o' ELSE model END AS model,
          CASE WHEN esc THEN status2 ELSE status END AS status, esc AS escalated, NOT (ok OR (esc AND ok2)) AS failed
        FROM (SELECT *, NOT ok AND model <> 'gpt-4o' AS esc FROM fx_attempts)""",
    "stream_failover_resolve": """
        SELECT request_id, CASE WHEN esc THEN 'gpt-4o' ELSE model END AS model,
          array_to_string(list_transform(range(chunks), lambda i: 'c' || request_id || '.1.' || i || ' '), '')
            || CASE WHEN esc THEN array_to_string(list_transform(range(3 - chunks), lambda i: 'c' || request_id || '.2.' || i || ' '), '')
                    WHEN stopped THEN '[Gateway Error: ' || status || ']' ELSE '' END AS text,
          esc AS escalated, esc AND chunks > 0 AS restarted, stopped AS failed
        FROM (SELECT *, NOT (ok AND chunks > 0) AND NOT (NOT ok AND model = 'gpt-4o') AS esc,
                NOT ok AND model = 'gpt-4o' AS stopped FROM fx_attempts)""",
    "model_404_fallback": f"""
        SELECT r.request_id, r.provider, a.status,
          CASE WHEN r.provider = 'gemini' AND a.status = 404 THEN 'gemini-pro' ELSE r.model END AS model
        FROM (SELECT request_id, model, {_PROVIDER} AS provider FROM ({_REQUESTED})) r
        JOIN fx_attempts a ON a.request_id = r.request_id""",
}
SQL = {key: with_ctes(text) for key, text in SQL.items()}
