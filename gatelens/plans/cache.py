"""Queries over cache keys, lookups, similarity search and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions import text as txt
from gatelens.functions import vectors as vec
from gatelens.operators import cache, embed, logs, pivots, replay, semantic
from gatelens.plans import fixtures as fx
from gatelens.plans.fixture_sql import CTES, with_ctes

AS_OF = "2024-01-01 01:05:00"
BOUND = 100  # far below the default, so that the bound acts on the test tables
ROWS_PER_CELL = 20
_DIGITS = 6


def keyed(spark, sf):
    return cache.with_cache_key(fx.prompts(spark, sf))


def entries(spark, sf):
    """Cache writes: every prompt was answered two seconds after it arrived."""
    done = F.struct(
        F.lit("gpt-4o").alias("model"),
        F.struct(
            (F.col("request_id") % 50).alias("prompt_tokens"),
            (F.col("request_id") % 70).alias("completion_tokens"),
            (F.col("request_id") % 50 + F.col("request_id") % 70).alias("total_tokens"),
        ).alias("usage"),
        (F.col("request_id") / 1000).alias("estimated_cost"),
        F.lit("intensive_reasoning").alias("strategy"),
    )
    return keyed(spark, sf).select(
        "prompt_hash",
        "tenant_salt",
        (F.col("arrival") + cache.seconds(2)).alias("stored_at"),
        (F.col("arrival") + cache.seconds(3602)).alias("expires_at"),
        F.col("request_id").alias("seq"),
        done.alias("response"),
    )


def cache_table(spark, sf):
    """The cache: one entry per hash, the last write."""
    writes = entries(spark, sf)
    return cache.upsert_cache(writes.limit(0), writes.drop("expires_at"))


def later_requests(spark, sf):
    """Every prompt asked again, some in other words, some after expiry, some before the answer is stored."""
    changed = F.when(F.col("request_id") % 3 == 0, F.concat(F.col("prompt"), F.lit(" please"))).otherwise(
        F.concat(F.lit("  "), F.translate("prompt", "aeiou", "AEIOU"))
    )
    again = fx.prompts(spark, sf).withColumn("prompt", changed)
    later = F.when(F.col("request_id") % 5 == 4, F.lit(1)).otherwise(F.lit(3000) + (F.col("request_id") * 7) % 900)
    arrival = F.col("arrival") + cache.seconds(later)
    return cache.with_cache_key(again.withColumn("arrival", arrival))


def prompt_normalize(spark, sf):
    return keyed(spark, sf).select("request_id", "normalized")


def tenant_salt(spark, sf):
    return keyed(spark, sf).select("request_id", "tenant_salt")


def prompt_hash(spark, sf):
    return keyed(spark, sf).select("request_id", "prompt_hash")


def cache_exact_lookup(spark, sf):
    found = cache.exact_lookup(later_requests(spark, sf), cache_table(spark, sf))
    return found.select("request_id", F.round("response.estimated_cost", 9).alias("cost"))


def cache_ttl_filter(spark, sf):
    return cache.live_entries(entries(spark, sf), AS_OF).select("seq", "stored_at")


def _used(spark, sf):
    used = keyed(spark, sf).groupBy("tenant_salt", "prompt_hash")
    return used.agg(F.max("arrival").alias("last_access"))


def cache_lru_bound(spark, sf):
    return cache.lru_bound(_used(spark, sf), BOUND).select("prompt_hash", "last_access")


def cache_lru_bound_per_tenant(spark, sf):
    return cache.lru_bound(_used(spark, sf), BOUND, by="tenant_salt").select("prompt_hash", "last_access")


def cache_fifo_bound(spark, sf):
    return cache.fifo_bound(fx.vector_index(spark, sf), BOUND, by="tenant").select("seq", "tenant")


def cache_fifo_bound_global(spark, sf):
    return cache.fifo_bound(fx.vector_index(spark, sf), BOUND).select("seq", "tenant")


def cache_upsert(spark, sf):
    old = cache.upsert_cache(entries(spark, sf).limit(0), entries(spark, sf).drop("expires_at"))
    fills = later_requests(spark, sf).select(
        "prompt_hash",
        "tenant_salt",
        F.col("arrival").alias("stored_at"),
        (F.col("request_id") + 1_000_000).alias("seq"),
        F.lit(None).cast(old.schema["response"].dataType).alias("response"),
    )
    return cache.upsert_cache(old, fills).select(
        "prompt_hash", "tenant_salt", "stored_at", "expires_at", "seq"
    )


def vector_l2_normalize(spark, sf):
    unit = vec.l2_normalize(F.col("vector"))
    # A vector is compared by its length and by its weighted sum of elements.
    weights = F.transform(F.sequence(F.lit(1), F.size("vector")), lambda i: i.cast("double"))
    return fx.vector_queries(spark, sf).select(
        "query_id",
        F.round(vec.norm(unit), _DIGITS).alias("length"),
        F.round(vec.dot(unit, weights), _DIGITS).alias("weighted_sum"),
    )


def cosine_similarity(spark, sf):
    stored = fx.vector_index(spark, sf).select("seq", F.col("vector").alias("stored"))
    pairs = fx.vector_queries(spark, sf).join(stored, F.col("query_id") == F.col("seq"))
    score = vec.cosine(F.col("vector"), F.col("stored"))
    return pairs.select("query_id", F.round(score, _DIGITS).alias("cosine"))


def _rounded(best):
    return best.select("query_id", "seq", F.round("score", _DIGITS).alias("score"))


def semantic_top1(spark, sf):
    return _rounded(semantic.semantic_top1(fx.vector_queries(spark, sf), fx.vector_index(spark, sf)))


def semantic_top1_global(spark, sf):
    return _rounded(
        semantic.semantic_top1(fx.vector_queries(spark, sf), fx.vector_index(spark, sf), scope="global")
    )


def semantic_top1_lsh(spark, sf):
    """The same through pivot cells, small ones, so that the bounds act on the test tables."""
    return _rounded(
        pivots.pivot_top1(fx.vector_queries(spark, sf), fx.vector_index(spark, sf), rows_per_cell=ROWS_PER_CELL)
    )


def semantic_top1_unbounded(spark, sf):
    return _rounded(
        pivots.pivot_top1(
            fx.vector_queries(spark, sf), fx.vector_index(spark, sf), scope="global", rows_per_cell=ROWS_PER_CELL
        )
    )


def _with_vectors(df, vectors, key: str):
    joined = df.join(vectors.withColumnRenamed(key, "__id"), F.col("request_id") == F.col("__id"), "left")
    return joined.drop("__id")


def tiered(spark, sf):
    table = cache_table(spark, sf)
    vectors = fx.vector_queries(spark, sf).select("query_id", "vector")
    asked = _with_vectors(later_requests(spark, sf), vectors, "query_id").withColumn(
        "tenant", F.col("tenant_salt")
    )
    stored = fx.vector_index(spark, sf).select(F.col("seq").alias("__seq"), "vector")
    index = table.join(stored, F.col("seq") == F.col("__seq")).select(
        "seq", F.col("tenant_salt").alias("tenant"), "prompt_hash", "vector"
    )
    return cache.tiered_lookup(asked, table, index)


def cache_tiered_lookup(spark, sf):
    return tiered(spark, sf).select(
        "request_id", "tier", F.round("response.estimated_cost", 9).alias("cost")
    )


def cache_fill_replay(spark, sf):
    replayed = replay.cache_replay(fx.cache_log(spark, sf))
    return replayed.select("request_id", "prompt_hash", "ts", "status", "filled_at")


def prompt_embed(spark, sf):
    """The buckets that a prompt fills, and the largest element of its unit vector."""
    places = F.transform("vector", lambda x, i: F.when(x > 0, i.cast("string")))
    return embed.embed(fx.prompts(spark, sf), "prompt").select(
        "request_id",
        F.array_join(places, ",").alias("buckets"),
        F.round(F.array_max("vector").cast("double"), 4).alias("largest"),
    )


def cache_replay_response(spark, sf):
    hits = cache.exact_lookup(later_requests(spark, sf), cache_table(spark, sf)).filter(
        F.col("response").isNotNull()
    )
    rows = cache.cache_hit_rows(hits.withColumn("lookup_ms", F.col("request_id") % 40))
    return logs.request_rows(rows)


QUERIES = {
    f.__name__: f
    for f in (
        prompt_normalize,
        tenant_salt,
        prompt_hash,
        cache_exact_lookup,
        cache_ttl_filter,
        cache_lru_bound,
        cache_lru_bound_per_tenant,
        cache_fifo_bound,
        cache_fifo_bound_global,
        cache_upsert,
        vector_l2_normalize,
        cosine_similarity,
        semantic_top1,
        semantic_top1_global,
        semantic_top1_lsh,
        semantic_top1_unbounded,
        cache_tiered_lookup,
        cache_fill_replay,
        prompt_embed,
        cache_replay_response,
    )
}

CTES["fx_cache_table"] = """
    SELECT prompt_hash, tenant_salt, seq, stored_at, stored_at + INTERVAL 3600 SECOND AS expires_at FROM (
      SELECT prompt_hash, tenant_salt, request_id AS seq, arrival + INTERVAL 2 SECOND AS stored_at,
        row_number() OVER (PARTITION BY prompt_hash ORDER BY arrival DESC, request_id DESC) AS rn
      FROM fx_keyed_prompts) WHERE rn = 1"""
CTES["fx_later"] = """
    SELECT *, sha256(tenant_salt || ':' || trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g'))) AS prompt_hash FROM (
      SELECT request_id, tenant_salt, arrival + to_seconds(CASE WHEN request_id % 5 = 4 THEN 1 ELSE 3000 + (request_id * 7) % 900 END) AS arrival,
        CASE WHEN request_id % 3 = 0 THEN prompt || ' please' ELSE '  ' || translate(prompt, 'aeiou', 'AEIOU') END AS prompt
      FROM fx_keyed_prompts)"""
CTES["fx_found"] = """
    SELECT r.request_id, r.tenant_salt, r.arrival, c.seq FROM fx_later r
    LEFT JOIN fx_cache_table c ON c.prompt_hash = r.prompt_hash AND c.stored_at <= r.arrival AND c.expires_at > r.arrival"""


def _top1(tenant_clause: str) -> str:
    return f"""
        SELECT query_id, seq, round(score, {_DIGITS}) AS score FROM (
          SELECT q.query_id, v.seq, list_cosine_similarity(q.vector, v.vector) AS score,
            row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.vector, v.vector) DESC, v.seq) AS rn
          FROM fx_vector_queries q, fx_vector_index v {tenant_clause})
        WHERE rn = 1 AND score >= 0.95"""




def embed_sql(source: str, key: str, text: str) -> str:
    """(key, bucket, x) of the unit vectors of texts, zeros left out."""
    return f"""
        SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (
          SELECT {key}, ('0x' || substr(md5(f), 1, 8))::BIGINT % {cfg.EMBEDDING_DIM} AS bucket, count(*)::DOUBLE AS n FROM (
            SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM (
              SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source}))
          GROUP BY 1, 2)"""


SQL = {
    "prompt_embed": f"""
        SELECT p.request_id, coalesce(e.buckets, '') AS buckets, coalesce(e.largest, 0) AS largest FROM fx_prompts p LEFT JOIN (
          SELECT request_id, string_agg(bucket, ',' ORDER BY bucket) AS buckets, round(max(x), 4) AS largest
          FROM ({embed_sql("fx_prompts", "request_id", "prompt")}) GROUP BY 1) e ON e.request_id = p.request_id""",
    "prompt_normalize": "SELECT request_id, normalized FROM fx_keyed_prompts",
    "tenant_salt": "SELECT request_id, tenant_salt FROM fx_keyed_prompts",
    "prompt_hash": "SELECT request_id, prompt_hash FROM fx_keyed_prompts",
    "cache_exact_lookup": "SELECT request_id, round(seq / 1000, 9) AS cost FROM fx_found",
    "cache_ttl_filter": f"""
        SELECT request_id AS seq, arrival + INTERVAL 2 SECOND AS stored_at FROM fx_keyed_prompts
        WHERE arrival + INTERVAL 3602 SECOND > TIMESTAMP '{AS_OF}'""",
    "cache_lru_bound": f"""
        SELECT prompt_hash, max(arrival) AS last_access FROM fx_keyed_prompts GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT {BOUND}""",
    "cache_lru_bound_per_tenant": f"""
        SELECT prompt_hash, last_access FROM (
          SELECT *, row_number() OVER (PARTITION BY tenant_salt ORDER BY last_access DESC, prompt_hash) AS rn FROM (
            SELECT tenant_salt, prompt_hash, max(arrival) AS last_access FROM fx_keyed_prompts GROUP BY 1, 2))
        WHERE rn <= {BOUND}""",
    "cache_fifo_bound": f"""
        SELECT seq, tenant FROM (
          SELECT seq, tenant, row_number() OVER (PARTITION BY tenant ORDER BY seq DESC) AS rn FROM fx_vector_index)
        WHERE rn <= {BOUND}""",
    "cache_fifo_bound_global": f"SELECT seq, tenant FROM fx_vector_index ORDER BY seq DESC LIMIT {BOUND}",
    "cache_upsert": """
        SELECT prompt_hash, tenant_salt, stored_at, stored_at + INTERVAL 3600 SECOND AS expires_at, seq FROM (
          SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY stored_at DESC, seq DESC) AS rn FROM (
            SELECT prompt_hash, tenant_salt, stored_at, seq FROM fx_cache_table
            UNION ALL SELECT prompt_hash, tenant_salt, arrival, request_id + 1000000 FROM fx_later)) WHERE rn = 1""",
    "vector_l2_normalize": f"""
        SELECT query_id, round(sqrt(list_dot_product(u, u)), {_DIGITS}) AS length,
          round(list_dot_product(u, list_transform(range(1, len(u) + 1), lambda i: i::DOUBLE)), {_DIGITS}) AS weighted_sum
        FROM (SELECT query_id, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS u
              FROM fx_vector_queries)""",
    "cosine_similarity": f"""
        SELECT query_id, round(list_cosine_similarity(q.vector, v.vector), {_DIGITS}) AS cosine
        FROM fx_vector_queries q JOIN fx_vector_index v ON v.seq = q.query_id""",
    "semantic_top1": _top1("WHERE q.tenant = v.tenant"),
    "semantic_top1_global": _top1(""),
    "semantic_top1_lsh": _top1("WHERE q.tenant = v.tenant"),
    "semantic_top1_unbounded": _top1(""),
    "cache_tiered_lookup": """
        SELECT f.request_id, CASE WHEN f.seq IS NOT NULL THEN 'exact' WHEN s.seq IS NOT NULL THEN 'semantic' ELSE 'miss' END AS tier,
          round(coalesce(f.seq, s.seq) / 1000, 9) AS cost
        FROM fx_found f LEFT JOIN (
          SELECT f.request_id, c.seq, list_cosine_similarity(q.vector, v.vector) AS score,
            row_number() OVER (PARTITION BY f.request_id ORDER BY list_cosine_similarity(q.vector, v.vector) DESC, c.seq) AS rn
          FROM fx_found f JOIN fx_vector_queries q ON q.query_id = f.request_id
          JOIN fx_cache_table c ON c.tenant_salt = f.tenant_salt AND c.stored_at <= f.arrival AND c.expires_at > f.arrival
          JOIN fx_vector_index v ON v.seq = c.seq
          WHERE f.seq IS NULL) s ON s.request_id = f.request_id AND s.rn = 1 AND s.score >= 0.95""",
    "cache_fill_replay": """
        WITH RECURSIVE fills(prompt_hash, filled_at) AS (
          SELECT prompt_hash, min(ts) FROM fx_cache_log GROUP BY 1
          UNION ALL
          SELECT f.prompt_hash, (SELECT min(l.ts) FROM fx_cache_log l WHERE l.prompt_hash = f.prompt_hash
            AND l.ts >= f.filled_at + INTERVAL 3600 SECOND) FROM fills f WHERE f.filled_at IS NOT NULL)
        SELECT l.request_id, l.prompt_hash, l.ts, CASE WHEN l.ts = f.filled_at THEN 'fill' ELSE 'hit' END AS status, f.filled_at
        FROM fx_cache_log l ASOF JOIN (SELECT * FROM fills WHERE filled_at IS NOT NULL) f
          ON f.prompt_hash = l.prompt_hash AND l.ts >= f.filled_at""",
    "cache_replay_response": """
        SELECT 'cache-' || f.request_id AS id, f.arrival AS timestamp, 'gpt-4o' AS model, 'openai' AS provider,
          f.seq % 50 AS prompt_tokens, f.seq % 70 AS completion_tokens, f.seq % 50 + f.seq % 70 AS total_tokens,
          f.seq / 1000 AS cost, 'intensive_reasoning' AS strategy, f.request_id % 40 AS latency_ms,
          true AS cached, true AS optimized
        FROM fx_found f WHERE f.seq IS NOT NULL""",
}
SQL = {key: with_ctes(text) for key, text in SQL.items()}
