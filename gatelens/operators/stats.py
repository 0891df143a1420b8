"""The statistics behind the dashboard: totals, series, recent requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.models import baseline_cost, exact_sum, status_color, status_label
from gatelens.operators.security import blocked_count


def summary_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.coalesce(exact_sum(F.col("cost")), F.lit(0.0)).alias("total_cost"),
        F.count_if(F.col("cached")).alias("queries_cached"),
    )


def model_distribution(log: DataFrame) -> DataFrame:
    """Requests per model; rows without a model form a group of their own."""
    return log.groupBy(F.col("model").alias("name")).agg(F.count(F.lit(1)).alias("usage"))


def display_round(savings: Column) -> Column:
    return F.when(savings < 1, F.round(savings, 4)).otherwise(F.round(savings, 2))


def global_savings(log: DataFrame) -> DataFrame:
    from gatelens.operators.cost import baseline_savings

    return baseline_savings(log).select(display_round(F.col("savings")).alias("total_savings"))


def _saved(cost: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    return F.greatest(F.lit(0.0), baseline_cost(prompt_tokens, completion_tokens) - cost)


def daily_cost_series(log: DataFrame, as_of: str, days: int = cfg.SERIES_DAYS) -> DataFrame:
    """Cost and savings of the last ``days`` calendar days, empty days as zero."""
    last = F.to_date(F.lit(as_of))
    first = F.date_sub(last, days - 1)
    # A range over the raw column, so that it reaches the scan.
    in_range = log.filter(
        (F.col("timestamp") >= first.cast("timestamp_ntz"))
        & (F.col("timestamp") < F.date_add(last, 1).cast("timestamp_ntz"))
    )
    daily = in_range.groupBy(F.to_date("timestamp").alias("day")).agg(
        exact_sum(F.col("cost")).alias("cost"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    calendar = log.sparkSession.range(days).select(
        F.date_add(first, F.col("id").cast("int")).alias("day")
    )
    zero = F.lit(0).cast("long")
    cost = F.coalesce(F.col("cost"), F.lit(0.0))
    tokens_in = F.coalesce(F.col("prompt_tokens"), zero)
    tokens_out = F.coalesce(F.col("completion_tokens"), zero)
    return calendar.join(daily, "day", "left").select(
        "day",
        F.date_format("day", "MM-dd").alias("label"),
        cost.alias("actual_cost"),
        _saved(cost, tokens_in, tokens_out).alias("saved_cost"),
    )


def recent_requests(log: DataFrame, n: int = cfg.RECENT_REQUESTS) -> DataFrame:
    """The newest requests; missing or zero token counts are taken as 25."""

    def tokens(column: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(cfg.MISSING_TOKENS))

    cost = F.coalesce(F.col("cost"), F.lit(0.0))
    baseline = baseline_cost(tokens("prompt_tokens"), tokens("completion_tokens"))
    cached = F.coalesce(F.col("cached"), F.lit(False))
    newest = log.select(
        "id", "timestamp", "model", "strategy", "cost", "cached", "prompt_tokens", "completion_tokens"
    ).orderBy(F.col("timestamp").desc(), F.col("id")).limit(n)
    return newest.select(
        F.right(F.col("id"), F.lit(cfg.RECENT_ID_CHARS)).alias("id"),
        "timestamp",
        F.coalesce(F.col("model"), F.lit("None")).alias("model"),
        "strategy",
        cost.alias("cost"),
        F.when(cached, baseline).otherwise(F.greatest(F.lit(0.0), baseline - cost)).alias(
            "savings_amt"
        ),
        status_label(cached, F.coalesce(F.col("model"), F.lit(""))).alias("status_text"),
        status_color(cached, F.coalesce(F.col("model"), F.lit(""))).alias("status_color"),
    )


def avg_latency(log: DataFrame) -> DataFrame:
    return log.agg(
        F.coalesce(F.avg("latency_ms").cast("long"), F.lit(0).cast("long")).alias("avg_latency")
    )


def traffic_log(recent: DataFrame) -> DataFrame:
    """Recent requests as the lines a dashboard table shows."""
    amount = F.format_string("$%.4f", F.greatest(F.col("savings_amt"), F.lit(0.0)))
    return recent.select(
        F.concat(F.lit("REQ-"), F.col("id"), F.lit(" [REDACTED]")).alias("request"),
        F.col("model").alias("route"),
        F.col("status_text").alias("status"),
        amount.alias("savings"),
    )


_MONEY = "decimal(38,12)"
CUBE_SUMS = ("n", "cost", "prompt_tokens", "completion_tokens", "cached", "latency_sum", "latency_n")


def log_cube(log: DataFrame) -> DataFrame:
    """Sums per (day, model); cubes of parts of a log add up to that of the whole, in any order."""
    return log.groupBy(F.to_date("timestamp").alias("day"), "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("cost").try_cast("decimal(30,12)")).cast(_MONEY).alias("cost"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.count_if(F.col("cached")).alias("cached"),
        F.sum("latency_ms").alias("latency_sum"),
        F.count("latency_ms").alias("latency_n"),
    )


def extend_cube(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add the cube of newly logged rows to the kept one; a repeated batch replaces its part."""
    log_cube(rows).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def kept_cube(spark: SparkSession, path: str) -> DataFrame:
    """The cube of all batches so far."""
    parts = spark.read.parquet(path)
    return parts.groupBy("day", "model").agg(*[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in CUBE_SUMS])


def compact_cube(spark: SparkSession, path: str, into: str) -> None:
    """The kept cube as one batch of a new folder, for the batches to come."""
    kept_cube(spark, path).write.mode("overwrite").parquet(f"{into}/batch_id=-1")


def _newest_days(log: DataFrame, cube: DataFrame, n: int) -> DataFrame:
    """The log's days that hold its newest ``n`` rows, as a range on the raw column."""
    per_day = cube.filter(F.col("day").isNotNull()).groupBy("day").agg(F.sum("n").alias("n"))
    held = 0
    for r in per_day.orderBy(F.col("day").desc()).limit(n).collect():  # each day has a row at least
        held += r.n
        if held >= n:
            return log.filter(F.col("timestamp") >= F.lit(r.day).cast("timestamp_ntz"))
    return log


def stats_summary(log: DataFrame, events: DataFrame, as_of: str, days: int = cfg.SERIES_DAYS,
                  n: int = cfg.RECENT_REQUESTS, cube: DataFrame | None = None) -> DataFrame:
    """All dashboard statistics as one row.

    Without ``cube`` the log is read twice: once into (day, model) sums, from which
    every total, the model mix and the daily series follow, and once for the newest
    rows.  With a kept cube only the newest days of the log are read.  The sums are
    days x models in size; only they are combined further.
    """
    newest_log = log if cube is None else _newest_days(log, cube, n)
    cube = log_cube(log) if cube is None else cube
    last = F.to_date(F.lit(as_of))
    first = F.date_sub(last, days - 1)
    added = [(exact_sum(F.col(c)) if c == "cost" else F.sum(c)).alias(c) for c in CUBE_SUMS]
    # Grouping sets over the small table: total, per model, per day.
    rolled = cube.groupingSets([[], ["model"], ["day"]], "model", "day").agg(
        F.grouping_id().alias("level"), *added
    )
    zero = F.lit(0).cast("long")

    def total(column: str, default: Column) -> Column:
        return F.coalesce(F.first(F.when(F.col("level") == 3, F.col(column)), True), default)

    per_model = F.sort_array(
        F.collect_list(
            F.when(F.col("level") == 1, F.struct(F.col("model").alias("name"), F.col("n").alias("usage")))
        )
    )
    in_series = (F.col("level") == 2) & F.col("day").between(first, last)
    per_day = F.map_from_entries(
        F.collect_list(
            F.when(
                in_series,
                F.struct(
                    "day",
                    F.struct("cost", "prompt_tokens", "completion_tokens").alias("v"),
                ),
            )
        )
    )
    folded = rolled.agg(
        total("n", zero).alias("total_queries"),
        total("cached", zero).alias("queries_cached"),
        total("cost", F.lit(0.0)).alias("cost"),
        total("prompt_tokens", zero).alias("tokens_in"),
        total("completion_tokens", zero).alias("tokens_out"),
        total("latency_sum", zero).alias("latency_sum"),
        total("latency_n", zero).alias("latency_n"),
        per_model.alias("top_models"),
        per_day.alias("by_day"),
    )
    calendar = F.sequence(first, last)

    def on(day: Column, name: str, default: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("by_day"), day)[name], default)

    def saved_on(day: Column) -> Column:
        return _saved(
            on(day, "cost", F.lit(0.0)),
            on(day, "prompt_tokens", zero),
            on(day, "completion_tokens", zero),
        )

    totals = folded.select(
        display_round(_saved(F.col("cost"), F.col("tokens_in"), F.col("tokens_out"))).alias(
            "total_savings"
        ),
        "total_queries",
        "queries_cached",
        F.when(F.col("latency_n") > 0, F.expr("latency_sum div latency_n"))
        .otherwise(zero)
        .alias("avg_latency"),
        "top_models",
        F.struct(
            F.transform(calendar, lambda d: F.date_format(d, "MM-dd")).alias("days"),
            F.transform(calendar, lambda d: on(d, "cost", F.lit(0.0))).alias("actual_cost"),
            F.transform(calendar, saved_on).alias("saved_cost"),
        ).alias("cost_over_time"),
    )
    recent = recent_requests(newest_log, n)
    shown = ["id", "model", "strategy", "cost", "savings_amt", "status_text", "status_color"]
    newest = recent.agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("age"),
                        *shown,
                    )
                )
            ),
            lambda r: F.struct(*[r[c].alias(c) for c in shown]),
        ).alias("recent_logs")
    )
    # The other two one-row aggregates come in as scalar subqueries, not as joins.
    return totals.select(
        "total_savings",
        "total_queries",
        "queries_cached",
        "avg_latency",
        blocked_count(events).scalar().alias("blocked_injections"),
        "top_models",
        newest.scalar().alias("recent_logs"),
        "cost_over_time",
    )
