"""Spend and savings per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.models import baseline_cost, exact_sum


def stream_cost_windows(log: DataFrame, size: str = "1 day", slide: str | None = None,
                        late: str = "1 hour") -> DataFrame:
    """Requests, tokens, cost and savings per window and model, over a log stream."""
    window = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    sums = log.withWatermark("timestamp", late).groupBy(window, "model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        exact_sum(F.col("cost")).alias("cost"),
    )
    saved = baseline_cost(F.col("prompt_tokens"), F.col("completion_tokens")) - F.col("cost")
    return sums.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "model",
        "requests",
        "prompt_tokens",
        "completion_tokens",
        "cost",
        F.greatest(F.lit(0.0), saved).alias("savings"),
    )
