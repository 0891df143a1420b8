"""The streaming operators, driven over the given tables until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions.sse import DONE
from gatelens.plans import fixtures as fx
from gatelens.plans.cache import SQL as CACHE_SQL
from gatelens.plans.fixture_sql import baseline, quote, with_ctes
from gatelens.plans.requests import SQL as REQUEST_SQL
from gatelens.plans.security import _FIRST, _GLYPHS, _expand_sql, redact_sql
from gatelens.session import fresh_path
from gatelens.streaming import cache, enrich, log, sse, windows


def _available(spark, source: str, schema, start) -> None:
    """Run a stream over everything now in ``source``; ``start`` begins the query."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, cache.ROCKSDB)
    try:
        start(spark.readStream.schema(schema).parquet(source)).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def _to_parquet(operator, out: str, marks: str):
    def start(stream: DataFrame):
        return (
            operator(stream)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start()
        )

    return start


def _in_batches(operator, write, marks: str, mode: str = "append"):
    def start(stream: DataFrame):
        return (
            operator(stream)
            .writeStream.foreachBatch(write)
            .outputMode(mode)
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start()
        )

    return start


def _streamed(spark, df: DataFrame, operator, cuts=()) -> DataFrame:
    """``df`` through a streaming operator into a Parquet sink, read back.

    With ``cuts`` (conditions splitting the rows) the parts arrive one after the
    other, and the stream is restarted from its checkpoint for each.
    """
    source, out, marks = (fresh_path(spark, p) for p in ("source", "sink", "checkpoint"))
    for part in [df.filter(c) for c in cuts] or [df]:
        part.write.mode("append").parquet(source)
        _available(spark, source, df.schema, _to_parquet(operator, out, marks))
    return spark.read.parquet(out)


def _batched(spark, df: DataFrame, operator, write, mode: str = "append", cuts=()) -> None:
    source, marks = fresh_path(spark, "source"), fresh_path(spark, "checkpoint")
    for part in [df.filter(c) for c in cuts] or [df]:
        part.write.mode("append").parquet(source)
        _available(spark, source, df.schema, _in_batches(operator, write, marks, mode))


def _raw_requests(spark, sf):
    key = F.concat(F.lit("Bearer key-"), (F.col("request_id") % 5).cast("string"))
    return fx.chat_requests(spark, sf).withColumn("api_key", key)


def stream_enrich(spark, sf):
    return _streamed(spark, _raw_requests(spark, sf), enrich.stream_enrich)


def _halves():
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return [F.col("ts") < middle, F.col("ts") >= middle]


def stream_exact_cache(spark, sf):
    """Requests in an order of their own; a last one, far behind, lets the watermark pass all."""
    requests = fx.cache_log(spark, sf)
    tick = requests.agg(
        F.lit(-1).cast(requests.schema["request_id"].dataType).alias("request_id"),
        F.lit("tick").alias("prompt_hash"),
        (F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"),
    )
    part = F.pmod(F.xxhash64("request_id"), F.lit(2))
    last = F.col("request_id") == -1
    rows = requests.select(*tick.columns).unionByName(tick)
    operator = lambda s: cache.stream_exact_cache(s, late="90 days")
    return _streamed(spark, rows, operator, [(part == 1) & ~last, (part == 0) & ~last, last])


def stream_cache_replay(spark, sf):
    out, state = fresh_path(spark, "replayed"), fresh_path(spark, "fills")
    sink = cache.replay_sink(out, state)
    _batched(spark, fx.cache_log(spark, sf), lambda s: s, sink, cuts=_halves())
    return spark.read.parquet(out).drop("batch_id")


_START = 1704067200


def _timed_lines(spark, sf):
    """Answer lines with times; DONE lines overtake the text of their streams."""
    seconds = F.greatest(F.col("seq"), F.lit(0)) % 100
    lines = fx.sse_lines(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(_START) + seconds))
    early = ((F.col("seq") < 40) & (F.col("stream_id") % 2 == 0)) | (F.col("line") == DONE)
    # An hour later the watermark has passed all.
    tick = spark.range(1).select(
        F.lit(-1).cast(lines.schema["stream_id"].dataType).alias("stream_id"),
        F.lit(0).cast("long").alias("seq"),
        F.lit(": keep-alive").alias("line"),
        F.timestamp_seconds(F.lit(_START + 3600)).alias("ts"),
    )
    return lines, early, tick


def stream_sse_assemble(spark, sf):
    lines, early, tick = _timed_lines(spark, sf)
    last = F.col("stream_id") == -1
    return _streamed(
        spark, lines.unionByName(tick), sse.stream_sse_assemble, [early & ~last, ~early & ~last, last]
    )


def stream_completion_records(spark, sf):
    """Records of streams whose requests come first, with the answer, or after it ended."""
    lines, early, tick = _timed_lines(spark, sf)
    turn = F.col("stream_id") % 3
    asked = fx.stream_requests(spark, sf).select(
        "stream_id", "prompt", "model", "strategy", "latency_ms",
        F.timestamp_seconds(F.lit(_START) + F.when(turn == 2, 3500).otherwise(0)).alias("ts"),
        F.when(turn == 0, 0).when(turn == 1, 1).otherwise(3).alias("part"),
    )
    part = F.when(F.col("stream_id") == -1, 2).when(early, 0).otherwise(1).alias("part")
    end = tick.withColumn("part", F.lit(3)).withColumn("ts", F.timestamp_seconds(F.lit(_START + 7000)))
    said = lines.unionByName(tick).select("*", part).unionByName(end)
    rows = said.unionByName(asked, allowMissingColumns=True)

    def operator(stream):
        return sse.stream_completion_records(
            stream.filter(F.col("line").isNotNull()), stream.filter(F.col("line").isNull()), late="1 minute"
        )

    found = _streamed(spark, rows, operator, [F.col("part") == k for k in range(4)])
    return found.withColumn("estimated_cost", F.round("estimated_cost", 9))


def stream_cost_windows(spark, sf):
    rows = fx.request_logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = fresh_path(spark, "windows")
    _batched(
        spark, rows, windows.stream_cost_windows, lambda df, i: log.write_batch(df, out, i), "update"
    )
    latest = log.latest_windows(spark.read.parquet(out), ["window_start", "model"])
    return latest.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "model",
        "requests",
        "prompt_tokens",
        "completion_tokens",
        F.round("cost", 9).alias("cost"),
        F.round("savings", 9).alias("savings"),
    )


def stream_log_dedup(spark, sf):
    once = fx.request_logs(spark, sf).select("id", F.col("timestamp").cast("timestamp"), "model", "total_tokens")
    deduped = _streamed(spark, once.unionByName(once), log.stream_log_dedup)
    return deduped.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def stream_security_sink(spark, sf):
    events, clean = fresh_path(spark, "events"), fresh_path(spark, "clean")
    _batched(spark, fx.injection_texts(spark, sf), lambda s: s, log.security_sink(events, clean))
    blocked = spark.read.parquet(events).select("id", F.lit("blocked").alias("outcome"))
    passed = spark.read.parquet(clean).select(
        F.col("request_id").alias("id"), F.lit("clean").alias("outcome")
    )
    return blocked.unionByName(passed)


def stream_semantic_lookup(spark, sf):
    out = fresh_path(spark, "lookups")
    sink = log.semantic_sink(lambda: fx.vector_index(spark, sf), out)
    _batched(spark, fx.vector_queries(spark, sf), lambda s: s, sink)
    return spark.read.parquet(out).select("query_id", "seq", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_enrich,
        stream_exact_cache,
        stream_cache_replay,
        stream_sse_assemble,
        stream_completion_records,
        stream_cost_windows,
        stream_log_dedup,
        stream_security_sink,
        stream_semantic_lookup,
    )
}


def _enrich_sql() -> str:
    from gatelens.plans.routing import _KEYWORDS, _LENGTH, _STRUCTURE, kind_sql, label_sql, strong_sql

    return f"""
        WITH last AS (SELECT request_id, text FROM fx_message_text WHERE pos = n - 1),
        flagged AS (SELECT request_id, CASE {_FIRST} END AS pattern FROM (
          SELECT request_id, lower(text) AS low FROM ({_expand_sql(f"SELECT request_id, {_GLYPHS} AS text FROM last")}))),
        redacted AS (SELECT request_id, {redact_sql("text")} AS text FROM last),
        scored AS (SELECT request_id, text, ({_KEYWORDS} + {_LENGTH} + {_STRUCTURE})::INTEGER AS score,
          sha256(substr(sha256('Bearer key-' || (request_id % 5)), 1, 16) || ':' ||
            trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS prompt_hash FROM redacted),
        labelled AS (SELECT s.*, {label_sql("s.score", "k.kind")} AS label
          FROM scored s LEFT JOIN ({kind_sql("redacted", "request_id", "text")}) k ON k.request_id = s.request_id)
        SELECT p.request_id, CASE WHEN p.reason IS NOT NULL THEN 'rejected' WHEN f.pattern IS NOT NULL THEN 'blocked'
          ELSE 'accepted' END AS outcome, f.pattern, s.text AS prompt, s.prompt_hash, s.score, s.label,
          CASE WHEN s.score IS NULL THEN NULL WHEN {strong_sql("s.score", "s.label")} THEN 'gpt-4o' ELSE 'gpt-3.5-turbo' END AS target_model,
          CASE WHEN s.score IS NULL THEN NULL WHEN {strong_sql("s.score", "s.label")} THEN 'intensive_reasoning'
            ELSE 'efficiency_optimized' END AS strategy
        FROM fx_parsed p LEFT JOIN flagged f ON f.request_id = p.request_id
        LEFT JOIN labelled s ON s.request_id = p.request_id AND f.pattern IS NULL"""


SQL = {
    "stream_enrich": with_ctes(_enrich_sql()),
    "stream_exact_cache": CACHE_SQL["cache_fill_replay"],
    "stream_cache_replay": CACHE_SQL["cache_fill_replay"],
    "stream_sse_assemble": with_ctes("SELECT * FROM fx_streams"),
    "stream_completion_records": REQUEST_SQL["stream_completion_record"],
    "stream_cost_windows": with_ctes(f"""
        SELECT day, model, requests, i AS prompt_tokens, o AS completion_tokens, round(c, 9) AS cost,
          round(greatest(0, {baseline("i", "o")} - c), 9) AS savings FROM (
          SELECT strftime(timestamp, '%Y-%m-%d') AS day, model, count(*)::BIGINT AS requests,
            sum(prompt_tokens)::BIGINT AS i, sum(completion_tokens)::BIGINT AS o, sum(cost) AS c
          FROM fx_request_logs GROUP BY 1, 2)"""),
    "stream_log_dedup": with_ctes("SELECT id, timestamp, model, total_tokens FROM fx_request_logs"),
    "stream_security_sink": with_ctes(f"""
        SELECT id, 'blocked' AS outcome FROM fx_security_events
        UNION ALL SELECT request_id, {quote("clean")} FROM fx_flagged WHERE pattern IS NULL"""),
    "stream_semantic_lookup": CACHE_SQL["semantic_top1"],
}
