"""Pricing of calls and savings against a baseline model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.models import baseline_cost, exact_sum
from gatelens.functions.once import literal_rows


def prices(spark: SparkSession) -> DataFrame:
    """The price dimension: one row per listed model."""
    rows = [(model, p_in, p_out) for model, (p_in, p_out) in cfg.PRICES.items()]
    return literal_rows(spark, ["model", "price_in", "price_out"], rows)


def with_cost(df: DataFrame, price_table: DataFrame | None = None,
              default: str = cfg.BASELINE_MODEL) -> DataFrame:
    """Add ``cost`` from model and token columns; unknown models cost the default.

    The built-in list is one row per model of the settings, so it is broadcast.
    A caller's own table (model, price_in, price_out) is joined without a hint:
    its size is the planner's to judge.  It also prices the default model.
    """
    if price_table is None:
        table = F.broadcast(prices(df.sparkSession))
        default_in, default_out = map(F.lit, cfg.PRICES[default])
    else:
        table = price_table.select("model", "price_in", "price_out")
        of_default = price_table.filter(F.col("model") == default)
        default_in = of_default.agg(F.first("price_in")).scalar()
        default_out = of_default.agg(F.first("price_out")).scalar()
    cost = (
        F.col("prompt_tokens") * F.coalesce(F.col("price_in"), default_in)
        + F.col("completion_tokens") * F.coalesce(F.col("price_out"), default_out)
    ) / F.lit(1e6)
    return df.join(table, "model", "left").withColumn("cost", cost).drop("price_in", "price_out")


def usage_by_price(log: DataFrame) -> DataFrame:
    """Every listed price with the tokens logged against it, unused models included."""
    used = log.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    zero = F.lit(0).cast("long")
    return prices(log.sparkSession).join(used, "model", "left").select(
        "model",
        "price_in",
        "price_out",
        *[
            F.coalesce(F.col(c), zero).alias(c)
            for c in ("requests", "prompt_tokens", "completion_tokens")
        ],
    )


def baseline_savings(log: DataFrame) -> DataFrame:
    """Spend, what the baseline model would have cost, and the saving, as one row.

    Tokens are summed as integers and priced once.
    """
    totals = log.agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(exact_sum(F.col("cost")), F.lit(0.0)).alias("actual_cost"),
    )
    baseline = baseline_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return totals.withColumn("baseline_cost", baseline).withColumn(
        "savings", F.greatest(F.lit(0.0), F.col("baseline_cost") - F.col("actual_cost"))
    )


def run_summary(log: DataFrame, by: str = "run_id") -> DataFrame:
    """Outcome, spend and savings against a flat token price per labelled run."""
    agg = log.groupBy(by).agg(
        F.count_if(F.col("success")).alias("passed"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success") & F.col("cached")).alias("cached"),
        F.sum("total_tokens").alias("total_tokens"),
        exact_sum(F.col("cost")).alias("total_cost"),
    )
    flat = F.col("total_tokens") * F.lit(cfg.FLAT_BASELINE_PER_TOKEN)
    saved = F.greatest(F.lit(0.0), F.col("baseline_cost") - F.col("total_cost"))
    return (
        agg.withColumn("baseline_cost", flat)
        .withColumn("savings", saved)
        .withColumn(
            "savings_pct",
            F.when(F.col("baseline_cost") > 0, F.col("savings") / F.col("baseline_cost") * 100)
            .otherwise(F.lit(0.0)),
        )
    )
