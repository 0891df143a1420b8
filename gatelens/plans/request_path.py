"""The whole request path as one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.operators import cache, request_path
from gatelens.plans import fixtures as fx
from gatelens.plans.cache import embed_sql
from gatelens.plans.fixture_sql import cost, with_ctes
from gatelens.plans.routing import _KEYWORDS, _LENGTH, _PROVIDER, _STRUCTURE, kind_sql, label_sql, strong_sql
from gatelens.plans.security import _FIRST, _GLYPHS, _expand_sql, redact_sql
from gatelens.session import work_table


def _raw(spark, sf):
    key = F.concat(F.lit("Bearer key-"), (F.col("request_id") % 5).cast("string"))
    return fx.chat_requests(spark, sf).select(
        "request_id", fx.after_epoch(F.col("request_id")).alias("arrival"), key.alias("api_key"), "json"
    )


def _writes(spark, sf):
    """A third of the prompts were asked before, another third in slightly other words."""
    checked = request_path.checked_requests(_raw(spark, sf)).filter("stopped IS NULL AND request_id % 3 < 2")
    other = F.when(F.col("request_id") % 3 == 1, F.concat("prompt", F.lit(" please"))).otherwise(F.col("prompt"))
    i = F.col("request_id")
    usage = F.struct(
        (i % 50).alias("prompt_tokens"), (i % 70).alias("completion_tokens"), (i % 50 + i % 70).alias("total_tokens")
    )
    done = F.struct(
        F.lit("gpt-4o").alias("model"),
        usage.alias("usage"),
        (F.col("request_id") / 1000).alias("estimated_cost"),
        F.lit("intensive_reasoning").alias("strategy"),
    )
    writes = cache.with_cache_key(checked.withColumn("prompt", other)).select(
        "prompt_hash",
        "tenant_salt",
        "normalized",
        (F.col("arrival") - cache.seconds(100)).alias("stored_at"),
        (F.col("arrival") + cache.seconds(3500)).alias("expires_at"),
        F.col("request_id").alias("seq"),
        done.alias("response"),
    )
    return work_table(writes, "cache-writes")


def _answers(spark, sf):
    """What providers answered; every fourth request fell over to the strong model."""
    i = F.col("request_id")
    return fx.chat_histories(spark, sf).select(
        "request_id",
        F.when(i % 4 == 0, "gpt-4o").alias("model"),
        (i % 50).alias("prompt_tokens"),
        (i % 70).alias("completion_tokens"),
        (i % 300).alias("latency_ms"),
    )


def _served(spark, sf):
    """The cache before a batch, and what the batch gives."""
    writes = _writes(spark, sf)
    # Carried as part of the entry, the prompt of the last write of a hash is what is embedded.
    table = cache.upsert_cache(writes.limit(0), writes.drop("expires_at"), ttl_s=3600)
    index = request_path.prompt_index(table)
    return table, request_path.serve_requests(_raw(spark, sf), table, index, _answers(spark, sf))


def chat_pipeline(spark, sf):
    return _served(spark, sf)[1].outcomes.withColumn("cost", F.round("cost", 9))


def chat_pipeline_log(spark, sf):
    """The log rows the request path leaves."""
    return _served(spark, sf)[1].log_rows.withColumn("cost", F.round("cost", 9))


def chat_pipeline_cache(spark, sf):
    """The cache the next batch finds."""
    table, served = _served(spark, sf)
    after = cache.upsert_cache(table, served.fills.drop("expires_at"))
    return after.select(
        "prompt_hash", "seq", "stored_at", "expires_at", "response.model", F.round("response.estimated_cost", 9).alias("cost")
    )


def chat_pipeline_events(spark, sf):
    """The security events of blocked requests."""
    return _served(spark, sf)[1].events


QUERIES = {f.__name__: f for f in (chat_pipeline, chat_pipeline_log, chat_pipeline_cache, chat_pipeline_events)}

_NORMAL = r"trim(regexp_replace(lower(prompt), '\s+', ' ', 'g'))"
_TIERS = rf"""
        last AS (SELECT request_id, text FROM fx_message_text WHERE pos = n - 1),
        flagged AS (SELECT request_id, CASE {_FIRST} END AS pattern FROM (
          SELECT request_id, lower(text) AS low FROM ({_expand_sql(f"SELECT request_id, {_GLYPHS} AS text FROM last")}))),
        going AS (SELECT l.request_id, {redact_sql("l.text")} AS prompt,
            substr(sha256('Bearer key-' || (l.request_id % 5)), 1, 16) AS tenant
          FROM last l JOIN flagged f ON f.request_id = l.request_id WHERE f.pattern IS NULL),
        asked AS (SELECT *, sha256(tenant || ':' || normalized) AS hash FROM (
          SELECT *, {_NORMAL} AS normalized FROM going)),
        writes AS (SELECT *, sha256(tenant || ':' || normalized) AS hash FROM (
          SELECT request_id, tenant, {_NORMAL} AS normalized FROM (
            SELECT request_id, tenant, CASE request_id % 3 WHEN 1 THEN prompt || ' please' ELSE prompt END AS prompt
            FROM going WHERE request_id % 3 < 2))),
        entries AS (SELECT request_id AS seq, tenant, normalized, hash, request_id - 100 AS since, request_id + 3500 AS until FROM (
          SELECT *, row_number() OVER (PARTITION BY hash ORDER BY request_id DESC) AS rn FROM writes) WHERE rn = 1),
        exact AS (SELECT a.request_id, e.seq FROM asked a JOIN entries e ON e.hash = a.hash
          AND e.since <= a.request_id AND a.request_id < e.until),
        qv AS ({embed_sql("asked", "request_id", "normalized")}),
        ev AS ({embed_sql("entries", "seq", "normalized")}),
        near AS (SELECT request_id, seq FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, seq) AS rn FROM (
            SELECT a.request_id, e.seq, sum(q.x * v.x) AS score
            FROM asked a JOIN entries e ON e.tenant = a.tenant AND e.since <= a.request_id AND a.request_id < e.until
            JOIN qv q ON q.request_id = a.request_id JOIN ev v ON v.seq = e.seq AND v.bucket = q.bucket
            GROUP BY 1, 2)) WHERE rn = 1 AND score >= {cfg.SIMILARITY_THRESHOLD}),
        scored AS (SELECT s.request_id, s.score, {label_sql("s.score", "k.kind")} AS label FROM (SELECT request_id, ({_KEYWORDS} + {_LENGTH} + {_STRUCTURE})::INTEGER AS score
          FROM (SELECT request_id, prompt AS text FROM asked)) s
          LEFT JOIN ({kind_sql("asked", "request_id", "normalized")}) k ON k.request_id = s.request_id),
        tiers AS (SELECT a.request_id, CASE WHEN x.seq IS NOT NULL THEN 'exact' WHEN n.seq IS NOT NULL THEN 'semantic' ELSE 'miss' END AS tier,
            coalesce(x.seq, n.seq) AS seq, a.tenant, a.normalized, a.hash,
            s.score, s.label, a.request_id % 50 AS prompt_tokens, a.request_id % 70 AS completion_tokens
          FROM asked a LEFT JOIN exact x USING (request_id) LEFT JOIN near n USING (request_id) JOIN scored s USING (request_id)),
        models AS (SELECT *, CASE WHEN tier <> 'miss' OR request_id % 4 = 0 OR {strong_sql("score", "label")}
            THEN 'gpt-4o' ELSE 'gpt-3.5-turbo' END AS model FROM tiers),
        served AS (SELECT *, {_PROVIDER} AS provider,
          CASE WHEN tier <> 'miss' OR {strong_sql("score", "label")} THEN 'intensive_reasoning'
            ELSE 'efficiency_optimized' END AS strategy,
          round(CASE WHEN tier <> 'miss' THEN seq / 1000 ELSE {cost()} END, 9) AS cost
        FROM models)"""
_AT = f"TIMESTAMP '{fx.EPOCH}' + to_seconds(request_id)"
_MS = "to_milliseconds(request_id % 300)"
SQL = {
    "chat_pipeline": rf"""
        SELECT request_id, tier AS outcome, NULL::VARCHAR AS pattern, model, provider, strategy, cost FROM served
        UNION ALL
        SELECT p.request_id, CASE WHEN p.reason IS NOT NULL THEN 'rejected' ELSE 'blocked' END, f.pattern, NULL, NULL, NULL, NULL
        FROM fx_parsed p LEFT JOIN flagged f ON f.request_id = p.request_id
        WHERE p.reason IS NOT NULL OR f.pattern IS NOT NULL""",
    "chat_pipeline_log": f"""
        SELECT CASE WHEN tier <> 'miss' THEN 'cache-' ELSE '' END || request_id AS id, {_AT} AS timestamp, model,
          CASE WHEN tier <> 'miss' THEN '{cfg.DEFAULT_PROVIDER}' ELSE provider END AS provider,
          (who % 50)::BIGINT AS prompt_tokens, (who % 70)::BIGINT AS completion_tokens,
          (who % 50 + who % 70)::BIGINT AS total_tokens, cost, strategy,
          (CASE WHEN tier = 'miss' THEN request_id % 300 ELSE 0 END)::BIGINT AS latency_ms,
          tier <> 'miss' AS cached, true AS optimized
        FROM (SELECT *, coalesce(seq, request_id) AS who FROM served)""",
    "chat_pipeline_cache": f"""
        SELECT prompt_hash, seq, stored_at, stored_at + INTERVAL 3600 SECOND AS expires_at, model, cost FROM (
          SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY stored_at DESC, seq DESC) AS rn FROM (
            SELECT hash AS prompt_hash, seq, TIMESTAMP '{fx.EPOCH}' + to_seconds(since) AS stored_at, 'gpt-4o' AS model,
              round(seq / 1000, 9) AS cost FROM entries
            UNION ALL SELECT hash, request_id, {_AT} + {_MS}, model, cost FROM served WHERE tier = 'miss')) WHERE rn = 1""",
    "chat_pipeline_events": f"""
        SELECT ('0x' || substr(sha256(f.request_id || ':injection_blocked'), 1, 15))::BIGINT AS id,
          TIMESTAMP '{fx.EPOCH}' + to_seconds(f.request_id) AS timestamp, 'injection_blocked' AS event_type,
          f.pattern AS pattern_matched, CASE WHEN length(l.text) > {cfg.EVENT_PREVIEW_CHARS}
            THEN left(l.text, {cfg.EVENT_PREVIEW_CHARS}) || '...' ELSE l.text END AS prompt_preview, NULL::VARCHAR AS source_ip
        FROM flagged f JOIN (SELECT request_id, {redact_sql("text")} AS text FROM last) l ON l.request_id = f.request_id
        WHERE f.pattern IS NOT NULL""",
}
SQL = {key: with_ctes(f"WITH {_TIERS} {text}") for key, text in SQL.items()}
