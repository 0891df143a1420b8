"""Comparing primary answers with shadow answers of another model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelens import settings as cfg


def shadow_pairs(primary: DataFrame, shadow: DataFrame) -> DataFrame:
    """Primary and shadow of the same request side by side, with deltas.

    Requests already answered by the shadow model have nothing to compare.
    """
    p, s = primary.alias("p"), shadow.alias("s")
    paired = p.join(
        s, (F.col("p.id") == F.col("s.id")) & (F.col("p.model") != F.col("s.model")), "inner"
    )
    return paired.select(
        F.col("p.id").alias("id"),
        F.to_date("p.timestamp").alias("day"),
        F.col("p.model").alias("primary_model"),
        F.col("s.model").alias("shadow_model"),
        F.col("s.latency_ms").alias("shadow_latency_ms"),
        F.col("s.total_tokens").alias("shadow_total_tokens"),
        (F.col("s.latency_ms") - F.col("p.latency_ms")).alias("latency_delta"),
        (F.col("s.total_tokens") - F.col("p.total_tokens")).alias("token_delta"),
        (F.col("s.cost") - F.col("p.cost")).alias("cost_delta"),
    )


MEASURES = ("shadow_latency_ms", "latency_delta")
LEADING_BITS = 7  # of a number that its bucket keeps: an error below one in 64


def bucket(x: Column) -> Column:
    """The number with all but its leading bits cut off, sign kept; small numbers stay exact."""
    size = F.abs(x.cast("long"))
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - LEADING_BITS, F.lit(0))).cast("long")
    return F.signum(x).cast("long") * (size - size % step)


def shadow_sketches(pairs: DataFrame) -> DataFrame:
    """(day, primary_model, shadow_model, measure, bucket, n): how often each bucket occurs.

    Sketches of parts of the data are merged by adding ``n``, in any order, so they can
    be kept per day and extended; their size does not grow with the requests.
    """
    long = pairs.select(
        "day",
        "primary_model",
        "shadow_model",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x"),
    )
    known = long.select("day", "primary_model", "shadow_model", "x.*").filter(F.col("bucket").isNotNull())
    return known.groupBy(*known.columns).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketches: DataFrame, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """One row per model pair with a column ``p<percent>_<measure>`` for each: the least bucket that reaches it."""
    pair = ["primary_model", "shadow_model"]
    merged = sketches.groupBy(*pair, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*pair, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("total", F.sum("n").over(own))
    reached = lambda m, p: F.when((F.col("measure") == m) & (F.col("upto") * 100 >= F.col("total") * p), F.col("bucket"))
    return upto.groupBy(*pair).agg(*[F.min(reached(m, p)).alias(f"p{p}_{m}") for m in MEASURES for p in percents])


def shadow_compare(primary: DataFrame, shadow: DataFrame,
                   strong: str = cfg.BASELINE_MODEL) -> DataFrame:
    """Per model pair: compared requests, mean deltas, latency percentiles and the price of the shadow."""
    default = shadow.withColumn("model", F.coalesce(F.col("model"), F.lit(strong)))
    pairs = shadow_pairs(primary, default)
    means = pairs.groupBy("primary_model", "shadow_model").agg(
        F.count(F.lit(1)).alias("compared"),
        F.avg("shadow_latency_ms").alias("avg_shadow_latency_ms"),
        F.avg("latency_delta").alias("avg_latency_delta"),
        F.sum("token_delta").alias("token_delta"),
        F.sum("cost_delta").alias("cost_delta"),
    )
    # Pairs without a single latency have means, but no percentiles.
    return means.join(sketch_quantiles(shadow_sketches(pairs)), ["primary_model", "shadow_model"], "left")
