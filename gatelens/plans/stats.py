"""Queries behind the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions.models import status_color, status_label
from gatelens.operators import shadow, stats
from gatelens.plans import fixtures as fx
from gatelens.plans.fixture_sql import baseline, with_ctes
from gatelens.plans.security import security_event_table
from gatelens.session import fresh_path


def summary_totals(spark, sf):
    return stats.summary_totals(fx.request_logs(spark, sf)).withColumn(
        "total_cost", F.round("total_cost", 9)
    )


def model_distribution(spark, sf):
    return stats.model_distribution(fx.request_logs(spark, sf))


def global_savings(spark, sf):
    return stats.global_savings(fx.request_logs(spark, sf))


def daily_cost_series(spark, sf):
    return _rounded_series(stats.daily_cost_series(fx.request_logs(spark, sf), fx.AS_OF))


def daily_cost_series_30(spark, sf):
    return _rounded_series(stats.daily_cost_series(fx.request_logs(spark, sf), "2024-02-03", 30))


def _rounded_series(series):
    return series.select(
        "label", F.round("actual_cost", 9).alias("actual_cost"), F.round("saved_cost", 9).alias("saved_cost")
    )


def recent_requests(spark, sf):
    recent = stats.recent_requests(fx.request_logs(spark, sf))
    return recent.withColumn("cost", F.round("cost", 9)).withColumn(
        "savings_amt", F.round("savings_amt", 9)
    )


def request_status_label(spark, sf):
    return fx.request_logs(spark, sf).select(
        "id",
        status_label(F.col("cached"), F.col("model")).alias("status_text"),
        status_color(F.col("cached"), F.col("model")).alias("status_color"),
    )


def avg_latency(spark, sf):
    return stats.avg_latency(fx.request_logs(spark, sf))


def _money(value):
    return F.format_string("%.9f", value)


def stats_summary(spark, sf):
    """The one-row summary; its lists are rendered as text to compare exactly."""
    return _as_text(stats.stats_summary(fx.request_logs(spark, sf), security_event_table(spark, sf), fx.AS_OF))


def stats_summary_kept(spark, sf):
    """The same from a cube that three appends extended, one of them twice."""
    log, path = fx.request_logs(spark, sf), fresh_path(spark, "cube")
    for batch_id in (0, 1, 1, 2):
        stats.extend_cube(log.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == batch_id), path, batch_id)
    kept = stats.kept_cube(spark, path)
    return _as_text(stats.stats_summary(log, security_event_table(spark, sf), fx.AS_OF, cube=kept))


def _as_text(summary):
    series = F.col("cost_over_time")
    return summary.select(
        "total_savings",
        "total_queries",
        "queries_cached",
        "avg_latency",
        "blocked_injections",
        F.array_join(
            F.transform("top_models", lambda m: F.concat(m["name"], F.lit("="), m["usage"].cast("string"))),
            ";",
        ).alias("top_models"),
        F.array_join(
            F.transform(
                "recent_logs",
                lambda r: F.concat_ws(
                    "|", r["id"], r["model"], r["strategy"], _money(r["cost"]), _money(r["savings_amt"]),
                    r["status_text"], r["status_color"],
                ),
            ),
            ";",
        ).alias("recent_logs"),
        F.array_join(series["days"], ";").alias("days"),
        F.array_join(F.transform(series["actual_cost"], _money), ";").alias("actual_cost"),
        F.array_join(F.transform(series["saved_cost"], _money), ";").alias("saved_cost"),
    )


def traffic_log_view(spark, sf):
    return stats.traffic_log(stats.recent_requests(fx.request_logs(spark, sf)))


def shadow_compare(spark, sf):
    compared = shadow.shadow_compare(fx.request_logs(spark, sf), fx.shadow_logs(spark, sf))
    return compared.select(
        "primary_model",
        "shadow_model",
        "compared",
        F.round("avg_shadow_latency_ms", 6).alias("avg_shadow_latency_ms"),
        F.round("avg_latency_delta", 6).alias("avg_latency_delta"),
        "token_delta",
        F.round("cost_delta", 9).alias("cost_delta"),
        *[f"p{p}_{m}" for m in shadow.MEASURES for p in (50, 95)],
    )


QUERIES = {
    f.__name__: f
    for f in (
        summary_totals,
        model_distribution,
        global_savings,
        daily_cost_series,
        daily_cost_series_30,
        recent_requests,
        request_status_label,
        avg_latency,
        stats_summary,
        stats_summary_kept,
        traffic_log_view,
        shadow_compare,
    )
}


def _series_sql(as_of: str, days: int) -> str:
    return f"""
        SELECT strftime(c.day, '%m-%d') AS label, round(coalesce(d.cost, 0), 9) AS actual_cost,
          round(greatest(0, {baseline("coalesce(d.i, 0)", "coalesce(d.o, 0)")} - coalesce(d.cost, 0)), 9) AS saved_cost
        FROM (SELECT unnest(generate_series(DATE '{as_of}' - {days - 1}, DATE '{as_of}', INTERVAL 1 DAY))::DATE AS day) c
        LEFT JOIN (SELECT timestamp::DATE AS day, sum(cost) AS cost, sum(prompt_tokens) AS i, sum(completion_tokens) AS o
                   FROM fx_request_logs GROUP BY 1) d ON d.day = c.day"""


_LABEL = """
    CASE WHEN cached THEN 'Cache Hit' WHEN contains(lower(model), 'llama') THEN '95% Saved' ELSE 'Quality Priority' END AS status_text,
    CASE WHEN cached THEN 'blue' WHEN contains(lower(model), 'llama') THEN 'teal' ELSE 'slate' END AS status_color"""
_BASE = baseline("coalesce(nullif(prompt_tokens, 0), 25)", "coalesce(nullif(completion_tokens, 0), 25)")
_RECENT = f"""
    SELECT right(id, 8) AS id, timestamp, model, strategy, cost,
      CASE WHEN cached THEN {_BASE} ELSE greatest(0, {_BASE} - cost) END AS savings_amt, {_LABEL}
    FROM fx_request_logs ORDER BY timestamp DESC, id LIMIT 5"""


def _percentiles(measure: str) -> str:
    """Least buckets that reach the percentiles, per model."""
    return f"""
        SELECT model, {", ".join(f"min(bucket) FILTER (upto * 100 >= total * {p})::BIGINT AS p{p}_{measure}" for p in (50, 95))} FROM (
          SELECT model, bucket, sum(n) OVER (PARTITION BY model ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY model) AS total FROM (
            SELECT model, sign({measure}) * (abs({measure}) - abs({measure}) %
              (1::BIGINT << greatest(length(bin(abs({measure})::BIGINT)) - {shadow.LEADING_BITS}, 0))) AS bucket, count(*) AS n
            FROM pairs WHERE {measure} IS NOT NULL GROUP BY 1, 2)) GROUP BY model"""


_TOTAL_SAVINGS = f"""
    SELECT CASE WHEN s < 1 THEN round(s, 4) ELSE round(s, 2) END AS total_savings FROM (
      SELECT greatest(0, {baseline("sum(prompt_tokens)", "sum(completion_tokens)")} - sum(cost)) AS s FROM fx_request_logs)"""

SQL = {
    "summary_totals": """
        SELECT count(*)::BIGINT AS total_queries, round(coalesce(sum(cost), 0), 9) AS total_cost,
          count(*) FILTER (cached)::BIGINT AS queries_cached FROM fx_request_logs""",
    "model_distribution": "SELECT model AS name, count(*)::BIGINT AS usage FROM fx_request_logs GROUP BY model",
    "global_savings": _TOTAL_SAVINGS,
    "daily_cost_series": _series_sql(fx.AS_OF, 7),
    "daily_cost_series_30": _series_sql("2024-02-03", 30),
    "recent_requests": f"SELECT * REPLACE (round(cost, 9) AS cost, round(savings_amt, 9) AS savings_amt) FROM ({_RECENT})",
    "request_status_label": f"SELECT id, {_LABEL} FROM fx_request_logs",
    "avg_latency": "SELECT trunc(avg(latency_ms))::BIGINT AS avg_latency FROM fx_request_logs",
    "stats_summary": f"""
        SELECT t.total_savings, a.total_queries, a.queries_cached, a.avg_latency, b.blocked_injections, m.top_models,
          r.recent_logs, s.days, s.actual_cost, s.saved_cost
        FROM ({_TOTAL_SAVINGS}) t,
          (SELECT count(*)::BIGINT AS total_queries, count(*) FILTER (cached)::BIGINT AS queries_cached,
             trunc(avg(latency_ms))::BIGINT AS avg_latency FROM fx_request_logs) a,
          (SELECT count(*)::BIGINT AS blocked_injections FROM fx_security_events) b,
          (SELECT string_agg(model || '=' || n, ';' ORDER BY model) AS top_models
           FROM (SELECT model, count(*) AS n FROM fx_request_logs GROUP BY model)) m,
          (SELECT string_agg(concat_ws('|', id, model, strategy, printf('%.9f', cost), printf('%.9f', savings_amt),
             status_text, status_color), ';' ORDER BY timestamp DESC, id) AS recent_logs FROM ({_RECENT})) r,
          (SELECT string_agg(label, ';' ORDER BY label) AS days, string_agg(printf('%.9f', actual_cost), ';' ORDER BY label) AS actual_cost,
             string_agg(printf('%.9f', saved_cost), ';' ORDER BY label) AS saved_cost FROM ({_series_sql(fx.AS_OF, 7)})) s""",
    "traffic_log_view": f"""
        SELECT 'REQ-' || id || ' [REDACTED]' AS request, model AS route, status_text AS status,
          '$' || printf('%.4f', greatest(savings_amt, 0)) AS savings FROM ({_RECENT})""",
    "shadow_compare": f"""
        WITH pairs AS (
          SELECT *, latency_ms + 100 + k AS shadow_latency_ms, 100 + k AS latency_delta
          FROM (SELECT *, ((prompt_tokens - 10) // 7) AS k FROM fx_request_logs) WHERE model <> 'gpt-4o'),
        means AS (
          SELECT model AS primary_model, 'gpt-4o' AS shadow_model, count(*)::BIGINT AS compared,
            round(avg(shadow_latency_ms), 6) AS avg_shadow_latency_ms, round(avg(latency_delta), 6) AS avg_latency_delta,
            sum(k)::BIGINT AS token_delta,
            round(sum((prompt_tokens * 5.0::DOUBLE + (completion_tokens + k) * 15.0::DOUBLE) / 1e6 - cost), 9) AS cost_delta
          FROM pairs GROUP BY model)
        SELECT m.*, {", ".join(f"p{p}_{x}" for x in shadow.MEASURES for p in (50, 95))} FROM means m
        {" ".join(f"LEFT JOIN ({_percentiles(x)}) {x}_q ON {x}_q.model = m.primary_model" for x in shadow.MEASURES)}""",
}
SQL["stats_summary_kept"] = SQL["stats_summary"]
SQL = {key: with_ctes(text) for key, text in SQL.items()}
