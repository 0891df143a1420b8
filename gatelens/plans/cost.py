"""Queries over prices, tokens and savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.models import baseline_cost, roi_percent
from gatelens.functions.text import token_count
from gatelens.operators import cost
from gatelens.plans import fixtures as fx
from gatelens.plans.fixture_sql import baseline, price_case, quote, with_ctes


def price_dimension(spark, sf):
    return cost.usage_by_price(fx.request_logs(spark, sf))


def request_cost(spark, sf):
    return fx.request_logs(spark, sf).select("id", "model", F.round("cost", 9).alias("cost"))


def roi_by_model(spark, sf):
    totals = fx.request_logs(spark, sf).groupBy("model").agg(
        F.sum("prompt_tokens").alias("i"), F.sum("completion_tokens").alias("o"), F.sum("cost").alias("c")
    )
    roi = roi_percent(F.col("c"), baseline_cost(F.col("i"), F.col("o")))
    return totals.select("model", F.round(roi, 6).alias("roi_percent"))


def document_tokens(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", token_count(F.col("text")).alias("token_count_est")
    )


def baseline_savings(spark, sf):
    rounded = [F.round(c, 9).alias(c) for c in ("actual_cost", "baseline_cost", "savings")]
    return cost.baseline_savings(fx.request_logs(spark, sf)).select(
        "prompt_tokens", "completion_tokens", *rounded
    )


def run_summary(spark, sf):
    rounded = [
        F.round(c, 6).alias(c) for c in ("total_cost", "baseline_cost", "savings", "savings_pct")
    ]
    return cost.run_summary(fx.run_log(spark, sf)).select(
        "run_id", "passed", "failed", "cached", "total_tokens", *rounded
    )


QUERIES = {
    "price_dimension": price_dimension,
    "request_cost": request_cost,
    "roi_percent": roi_by_model,
    "token_count": document_tokens,
    "baseline_savings": baseline_savings,
    "run_summary": run_summary,
}

_PRICES = ", ".join(f"({quote(m)}, {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in cfg.PRICES.items())

SQL = {
    "price_dimension": f"""
        SELECT p.model, p.price_in, p.price_out, count(l.id)::BIGINT AS requests,
          coalesce(sum(l.prompt_tokens), 0)::BIGINT AS prompt_tokens,
          coalesce(sum(l.completion_tokens), 0)::BIGINT AS completion_tokens
        FROM (VALUES {_PRICES}) p(model, price_in, price_out)
        LEFT JOIN fx_request_logs l ON l.model = p.model GROUP BY ALL""",
    "request_cost": f"""
        SELECT id, model, round((prompt_tokens * {price_case("model", 0)}
          + completion_tokens * {price_case("model", 1)}) / 1e6, 9) AS cost FROM fx_raw_logs""",
    "roi_percent": f"""
        SELECT model, round(CASE WHEN b = 0 THEN 0 ELSE (b - c) / b * 100 END, 6)::DOUBLE AS roi_percent FROM (
          SELECT model, sum(cost) AS c, {baseline("sum(prompt_tokens)", "sum(completion_tokens)")} AS b
          FROM fx_request_logs GROUP BY model)""",
    "token_count": f"""
        SELECT doc_id, len(regexp_extract_all(text, {quote(cfg.PRETOKEN_PATTERN)}))::BIGINT AS token_count_est
        FROM documents""",
    "baseline_savings": f"""
        SELECT i AS prompt_tokens, o AS completion_tokens, round(c, 9) AS actual_cost, round(b, 9) AS baseline_cost,
          round(greatest(0, b - c), 9) AS savings FROM (
          SELECT sum(prompt_tokens)::BIGINT AS i, sum(completion_tokens)::BIGINT AS o, sum(cost) AS c,
            {baseline("sum(prompt_tokens)", "sum(completion_tokens)")} AS b FROM fx_request_logs)""",
    "run_summary": f"""
        SELECT run_id, passed, failed, cached, total_tokens, round(c, 6) AS total_cost, round(b, 6) AS baseline_cost,
          round(greatest(0, b - c), 6) AS savings,
          round(CASE WHEN b > 0 THEN greatest(0, b - c) / b * 100 ELSE 0 END, 6) AS savings_pct FROM (
          SELECT strftime(timestamp, '%Y-%m-%d') AS run_id,
            count(*) FILTER (model <> 'unlisted-model')::BIGINT AS passed,
            count(*) FILTER (model = 'unlisted-model')::BIGINT AS failed,
            count(*) FILTER (model <> 'unlisted-model' AND cached)::BIGINT AS cached,
            sum(total_tokens)::BIGINT AS total_tokens, sum(cost) AS c,
            sum(total_tokens)::DOUBLE * {cfg.FLAT_BASELINE_PER_TOKEN}::DOUBLE AS b
          FROM fx_request_logs GROUP BY 1)""",
}
SQL = {key: with_ctes(text) for key, text in SQL.items()}
