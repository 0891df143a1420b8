"""Choosing a model per prompt and resolving what providers made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.models import provider_of, usable_key
from gatelens.functions.once import compute_once, literal_rows
from gatelens.functions.scoring import heuristic_score
from gatelens.functions.vectors import dot, l2_normalize


def _centroid(exemplars: DataFrame, kind: str) -> Column:
    """Mean of the unit exemplars of one kind, as a scalar subquery."""
    units = exemplars.filter(F.col("kind") == kind).select(
        F.posexplode(l2_normalize(F.col("vector"))).alias("i", "x")
    )
    means = units.groupBy("i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.agg(F.transform(ordered, lambda p: p["x"]).alias("c")).scalar()


def exemplar_similarity(df: DataFrame, vec: str, exemplars: DataFrame) -> DataFrame:
    """Mean cosine to the complex and the trivial exemplars, and the nearer kind.

    The mean of cosines is one product with the mean of the unit exemplars, so
    each prompt costs two products however many exemplars there are.
    """
    scored = (
        df.withColumn("__unit", l2_normalize(F.col(vec)))
        .withColumn("__complex", _centroid(exemplars, "complex"))
        .withColumn("__trivial", _centroid(exemplars, "trivial"))
        .withColumn("avg_complex", dot(F.col("__unit"), F.col("__complex")))
        .withColumn("avg_trivial", dot(F.col("__unit"), F.col("__trivial")))
        .drop("__unit", "__complex", "__trivial")
    )
    label = F.when(F.col(vec).isNull(), F.lit(None)).otherwise(
        F.when(F.col("avg_complex") > F.col("avg_trivial"), "complex").otherwise("trivial")
    )
    return scored.withColumn("label", label)


def ambiguous(score: Column) -> Column:
    """Scores the heuristic leaves to the classifier."""
    return (score > cfg.LEAN_SCORE) & (score < cfg.STRONG_SCORE)


def sample_exemplars(spark: SparkSession, encoder=None) -> DataFrame:
    """(kind, text, vector) of the built-in sample prompts, embedded as the prompts are."""
    from gatelens.operators.embed import embed

    rows = [("complex", t) for t in cfg.COMPLEX_EXEMPLARS]
    rows += [("trivial", t) for t in cfg.TRIVIAL_EXEMPLARS]
    return embed(literal_rows(spark, ["kind", "text"], rows), "text", encoder)


def label_open(scored: DataFrame, vec: str, exemplars: DataFrame) -> DataFrame:
    """Add the classifier's ``label`` to scores the heuristic leaves open; it is NULL elsewhere.

    The exemplars are folded to two centroids, so this is one pass without a
    shuffle and works on a stream as well.
    """
    labelled = exemplar_similarity(scored, vec, exemplars).drop("avg_complex", "avg_trivial")
    return labelled.withColumn("label", F.when(ambiguous(F.col("score")), F.col("label")))


def decide_route(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    lean: Column | None = None,
    strong: Column | None = None,
    respect_explicit: bool = False,
) -> DataFrame:
    """Add ``target_model`` and ``strategy`` from a score and a classifier label.

    A NULL label means the classifier was not available.  ``respect_explicit``
    keeps a requested model other than ``auto`` (column ``model``).
    """
    default = cfg.MODEL_PAIRS[0]
    lean = F.lit(default[1]) if lean is None else lean
    strong = F.lit(default[2]) if strong is None else strong
    s, kind = F.col(score), F.col(label)
    complex_ = (s >= cfg.STRONG_SCORE) | (ambiguous(s) & (kind == "complex"))
    trivial = (s <= cfg.LEAN_SCORE) | (ambiguous(s) & (kind == "trivial"))
    target = (
        F.when(complex_, strong)
        .when(trivial, lean)
        .when(s >= cfg.FALLBACK_STRONG_SCORE, strong)
        .otherwise(lean)
    )
    strategy = (
        F.when(complex_, "intensive_reasoning")
        .when(trivial, "efficiency_optimized")
        .otherwise("balanced_performance")
    )
    if respect_explicit:
        explicit = F.coalesce(F.col("model"), F.lit("auto")) != "auto"
        target = F.when(explicit, F.col("model")).otherwise(target)
        strategy = F.when(explicit, "explicit_model").otherwise(strategy)
    return df.withColumn("target_model", target).withColumn("strategy", strategy)


def route_prompts(
    df: DataFrame,
    text: str = "text",
    exemplars: DataFrame | None = None,
    encoder=None,
    **decision,
) -> DataFrame:
    """Score every prompt; embed and classify only those the score leaves open.

    With ``exemplars`` None the built-in sample prompts are embedded by the same
    encoder; pass ``exemplars`` to classify against stored vectors.
    """
    from gatelens.operators.embed import embed

    scored = compute_once(df, score=heuristic_score(F.col(text)))
    clear = scored.filter(~ambiguous(F.col("score"))).withColumn(
        "label", F.lit(None).cast("string")
    )
    if exemplars is None:
        exemplars = sample_exemplars(df.sparkSession, encoder)
    open_ = embed(scored.filter(ambiguous(F.col("score"))), text, encoder, out="__vec")
    labelled = exemplar_similarity(open_, "__vec", exemplars).drop(
        "__vec", "avg_complex", "avg_trivial"
    )
    return decide_route(clear.unionByName(labelled), **decision)


def model_pair(keys: DataFrame) -> DataFrame:
    """(tenant, lean_model, strong_model) by the first provider with a usable key."""
    rank = F.lit(None).cast("int")
    for position, (provider, _, _) in reversed(list(enumerate(cfg.MODEL_PAIRS))):
        rank = F.when(F.col("provider") == provider, F.lit(position)).otherwise(rank)
    usable = F.when(usable_key(F.col("api_key")), rank)
    first = keys.groupBy("tenant").agg(F.min(usable).alias("first"))

    def name(place: int) -> Column:
        names = F.array(*[F.lit(pair[place]) for pair in cfg.MODEL_PAIRS])
        return F.coalesce(F.get(names, F.col("first")), F.lit("none"))

    return first.select("tenant", name(1).alias("lean_model"), name(2).alias("strong_model"))


def with_provider(df: DataFrame, model: str = "model") -> DataFrame:
    """Add ``provider``; a request without a usable model gets an ``error``."""
    provider = provider_of(F.col(model))
    return df.withColumn("provider", provider).withColumn(
        "error", F.when(provider.isNull(), F.lit("no valid api keys"))
    )


def _outcome(attempts: DataFrame, strong: str) -> DataFrame:
    """Primary and second attempt of each request side by side."""
    first, second = F.col("attempt_no") == 1, F.col("attempt_no") == 2

    def of(which: Column, column: str) -> Column:
        return F.max(F.when(which, F.col(column)))

    return attempts.groupBy("request_id").agg(
        of(first, "model").alias("primary_model"),
        of(first, "ok").alias("primary_ok"),
        of(first, "status").alias("primary_status"),
        F.coalesce(of(second, "ok"), F.lit(False)).alias("second_ok"),
        of(second, "status").alias("second_status"),
    ).withColumn("was_strong", F.col("primary_model") == strong)


def resolve_attempts(attempts: DataFrame, strong: str = cfg.BASELINE_MODEL) -> DataFrame:
    """The attempt that answered each request.

    A failed primary escalates to the strong model unless it was the strong one.
    """
    done = F.col("primary_ok")
    escalated = ~done & ~F.col("was_strong")
    ok = done | (escalated & F.col("second_ok"))
    status = F.when(escalated, F.col("second_status")).otherwise(F.col("primary_status"))
    return _outcome(attempts, strong).select(
        "request_id",
        F.when(escalated, F.lit(strong)).otherwise(F.col("primary_model")).alias("model"),
        status.alias("status"),
        escalated.alias("escalated"),
        (~ok).alias("failed"),
    )


def resolve_streams(attempts: DataFrame, chunks: DataFrame,
                    strong: str = cfg.BASELINE_MODEL) -> DataFrame:
    """What the client of each stream received.

    A primary that ends with at least one chunk is final.  One that fails, or
    ends empty, is continued by the strong model after whatever was sent; only a
    failing strong primary ends in an error text instead.
    """
    parts = F.array_sort(F.collect_list(F.struct("attempt_no", "seq", "delta")))
    sent = chunks.groupBy("request_id").agg(
        parts.alias("parts"), F.count_if(F.col("attempt_no") == 1).alias("sent_first")
    )
    joined = _outcome(attempts, strong).join(sent, "request_id", "left").withColumn(
        "sent_first", F.coalesce("sent_first", F.lit(0).cast("long"))
    )
    final = F.col("primary_ok") & (F.col("sent_first") > 0)
    stopped = ~F.col("primary_ok") & F.col("was_strong")
    escalated = ~final & ~stopped
    taken = F.filter("parts", lambda p: (p["attempt_no"] == 1) | escalated)
    text = F.coalesce(F.array_join(F.transform(taken, lambda p: p["delta"]), ""), F.lit(""))
    error = F.concat(F.lit("[Gateway Error: "), F.col("primary_status").cast("string"), F.lit("]"))
    return joined.select(
        "request_id",
        F.when(escalated, F.lit(strong)).otherwise(F.col("primary_model")).alias("model"),
        F.concat(text, F.when(stopped, error).otherwise(F.lit(""))).alias("text"),
        escalated.alias("escalated"),
        (escalated & (F.col("sent_first") > 0)).alias("restarted"),
        stopped.alias("failed"),
    )
