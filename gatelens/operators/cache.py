"""Cache tables: lookup, expiry, bounds, merge and replayed hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelens import settings as cfg
from gatelens.functions.text import normalize_prompt, prompt_hash, tenant_salt
from gatelens.session import work_table

_NEVER = -(1 << 62)  # before any time or number


def seconds(n: int | Column) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, F.lit(n))


def with_cache_key(requests: DataFrame, prompt: str = "prompt", api_key: str = "api_key") -> DataFrame:
    """Add ``normalized``, ``tenant_salt`` and ``prompt_hash``."""
    return (
        requests.withColumn("normalized", normalize_prompt(F.col(prompt)))
        .withColumn("tenant_salt", tenant_salt(F.col(api_key)))
        .withColumn("prompt_hash", prompt_hash(F.col("tenant_salt"), F.col("normalized")))
    )


def live_entries(cache: DataFrame, as_of: str, ttl_s: int = cfg.CACHE_TTL_S) -> DataFrame:
    """Entries not yet expired; the bound is on the raw column and reaches the scan."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - seconds(ttl_s)
    return cache.filter(F.col("stored_at") > oldest)


def exact_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Every request with the response of its live cache entry, or NULL.

    An entry answers from its write on until it expires.  ``cache`` is a snapshot
    with one row per hash, so requests are never multiplied.  A hash that many
    requests share is split by the adaptive skew join.
    """
    r, c = requests.alias("r"), cache.select("prompt_hash", "response", "stored_at", "expires_at").alias("c")
    arrival = F.col("r.arrival")
    alive = (F.col("c.stored_at") <= arrival) & (F.col("c.expires_at") > arrival)
    return r.join(c, (F.col("r.prompt_hash") == F.col("c.prompt_hash")) & alive, "left").select(
        "r.*", "c.response"
    )


def _newest(df: DataFrame, n: int, by: str | None, levels: list[tuple[Column, bool]], order: list[Column]) -> DataFrame:
    """The first ``n`` rows by ``order``, overall or per ``by``.

    ``levels`` are columns without nulls, coarse to fine, that rise (True) or fall
    along ``order``.  Counts per value of the first tell where the n-th row is, counts
    of the next within that value narrow it down, and so on.  Rows before the last
    value are kept as they are; only those that share it on all levels are ranked.
    """
    own, edge_of = [f"__level{i}" for i in range(len(levels))], [f"__edge{i}" for i in range(len(levels))]
    by_col = F.lit(0) if by is None else F.col(by)
    rows = df.withColumns({"__by": by_col, **dict(zip(own, (c for c, _ in levels), strict=True))})
    edges = None
    for i, (_, rises) in enumerate(levels):
        inside, need = rows, F.lit(n).cast("long")
        if edges is not None:
            same = [F.col(o) == F.col(e) for o, e in zip(own[:i], edge_of[:i], strict=True)]
            inside = rows.join(edges, reduce(and_, same, F.col("__by").eqNullSafe(F.col("__of"))))
            need = F.col("__need")
        known = ["__need", *edge_of[:i]] if i else []
        counts = inside.groupBy("__by", own[i], *known).agg(F.count(F.lit(1)).alias("__rows"))
        along = F.col(own[i]).asc() if rises else F.col(own[i]).desc()
        earlier = Window.partitionBy("__by").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
        at_edge = counts.filter((F.col("__before") < need) & (F.col("__before") + F.col("__rows") >= need))
        edges = at_edge.select(
            F.col("__by").alias("__of"), (need - F.col("__before")).alias("__need"), *edge_of[:i], F.col(own[i]).alias(edge_of[i])
        )
    edges = work_table(edges, "eviction-edges")  # one row per ``by``
    if by is None:
        edge = edges.first()
        if edge is None:
            return df
        placed = rows.withColumns({c: F.lit(edge[c]) for c in ("__need", *edge_of)})
    else:
        placed = rows.join(edges, F.col("__by").eqNullSafe(F.col("__of")), "left")
    last, before = F.lit(True), F.lit(False)
    for o, e, (_, rises) in reversed(list(zip(own, edge_of, levels, strict=True))):
        ahead = F.col(o) < F.col(e) if rises else F.col(o) > F.col(e)
        last, before = (F.col(o) == F.col(e)) & last, ahead | ((F.col(o) == F.col(e)) & before)
    kept = placed.filter(F.col("__need").isNull() | before)
    rank = F.row_number().over(Window.partitionBy("__by").orderBy(*order))
    ranked = placed.filter(last).withColumn("__rank", rank).filter(F.col("__rank") <= F.col("__need"))
    return kept.select(*df.columns).unionAll(ranked.select(*df.columns))


def lru_bound(cache: DataFrame, n: int = cfg.CACHE_MAX_ENTRIES, by: str | None = None) -> DataFrame:
    """The ``n`` most recently used entries, overall or per ``by``; those never used count as the oldest."""
    micros = F.coalesce(F.unix_micros(F.col("last_access").cast("timestamp")), F.lit(_NEVER))
    levels = [
        (F.floor(micros / 60_000_000), False),
        (F.floor(micros / 10_000), False),
        (micros, False),
        (F.coalesce(F.substring("prompt_hash", 1, 3), F.lit("")), True),  # a bulk load at one instant
    ]
    return _newest(cache, n, by, levels, [F.col("last_access").desc_nulls_last(), F.col("prompt_hash")])


def fifo_bound(index: DataFrame, n: int = cfg.CACHE_MAX_ENTRIES, by: str | None = None) -> DataFrame:
    """The ``n`` most recently inserted entries, overall or per ``by``; those without a number count as the oldest."""
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(_NEVER))
    levels = [(F.floor(seq / 1_000_000), False), (F.floor(seq / 1_000), False)]
    return _newest(index, n, by, levels, [F.col("seq").desc_nulls_last()])


def upsert_cache(cache: DataFrame, fills: DataFrame, ttl_s: int = cfg.CACHE_TTL_S) -> DataFrame:
    """New fills over old entries: the last write of a hash wins and restarts its life.

    A maximum per hash, so rewrites of a hot hash collapse before the shuffle.
    """
    fresh = fills.withColumn("expires_at", F.col("stored_at") + seconds(ttl_s))
    merged = cache.unionByName(fresh.select(*cache.columns))
    rest = [c for c in cache.columns if c not in ("prompt_hash", "stored_at", "seq")]
    whole = F.struct("stored_at", "seq", *rest)
    last = F.max_by(whole, F.struct("stored_at", "seq"))
    return merged.groupBy("prompt_hash").agg(last.alias("e")).select("prompt_hash", "e.*").select(
        *cache.columns
    )


def tiered_lookup(
    requests: DataFrame,
    cache: DataFrame,
    index: DataFrame,
    threshold: float = cfg.SIMILARITY_THRESHOLD,
    scope: str = "tenant",
    vectors: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact tier, then the most similar live entry, else a miss; adds tier and response.

    ``index`` holds (seq, tenant, prompt_hash, vector).  Only requests the exact
    tier missed reach the vector search.  In both tiers an entry answers from its
    write on until it expires.

    Requests bring their ``vector``, or ``vectors`` adds it to those that the exact
    tier missed; then exact hits have none, and what was embedded is kept in a work
    table, so that nothing is embedded twice.
    """
    from gatelens.operators.semantic import semantic_top1

    looked_up = exact_lookup(requests, cache)
    if vectors is not None:
        embedded = vectors(looked_up.filter(F.col("response").isNull()))
        hits = looked_up.filter(F.col("response").isNotNull())
        looked_up = work_table(embedded.unionByName(hits, allowMissingColumns=True), "looked-up")
    missed = looked_up.filter(F.col("response").isNull())
    live_index = index.join(cache.select("prompt_hash", "stored_at", "expires_at"), "prompt_hash").select(
        "seq", "tenant", "vector", "stored_at", "expires_at"
    )
    best = semantic_top1(
        missed.select(F.col("request_id").alias("query_id"), "tenant", "vector", "arrival"),
        live_index,
        threshold,
        scope,
        sizing=requests,
    )
    # Only the few winners look up their entry; vectors and responses never meet.
    hashes = best.join(index.select("seq", "prompt_hash"), "seq")
    found = hashes.join(cache.select("prompt_hash", F.col("response").alias("__near")), "prompt_hash").select(
        F.col("query_id").alias("request_id"), "__near"
    )
    tier = F.when(F.col("response").isNotNull(), "exact").when(F.col("__near").isNotNull(), "semantic").otherwise("miss")
    return (
        looked_up.join(found, "request_id", "left")
        .withColumns({"tier": tier, "response": F.coalesce("response", "__near")})
        .drop("__near")
    )


def cache_hit_rows(hits: DataFrame) -> DataFrame:
    """Hits as completions to be logged: a fresh id, cached, the lookup's latency."""
    return hits.select(
        F.concat(F.lit("cache-"), F.col("request_id").cast("string")).alias("id"),
        F.col("arrival").alias("timestamp"),
        F.col("response.model").alias("model"),
        F.lit(None).cast("string").alias("provider"),
        F.col("response.usage").alias("usage"),
        F.col("response.estimated_cost").alias("estimated_cost"),
        F.col("response.strategy").alias("strategy"),
        F.col("lookup_ms").cast("long").alias("latency_ms"),
        F.lit(True).alias("cached"),
        F.lit(True).alias("optimized"),
    )
