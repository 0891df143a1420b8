"""Sources, sinks, parsing and the edge rows of the statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gatelens.functions import messages as msg
from gatelens.operators import cache, logs, security, shadow, stats
from gatelens.plans import fixtures
from gatelens.sources import requests, tables

BASE = datetime.datetime(2024, 3, 1)
COMPLETION = (
    "id string, timestamp timestamp_ntz, model string, provider string, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>, estimated_cost double, "
    "strategy string, latency_ms bigint, cached boolean, optimized boolean"
)


def completion(i, at=BASE, model="gpt-4o", usage=(10, 5, 15), cost=0.5, cached=None):
    return (i, at, model, None, usage, cost, None, None, cached, None)


def test_append_and_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    days = [BASE + datetime.timedelta(days=d) for d in range(3)]
    first = spark.createDataFrame([completion(f"a{d.day}", d) for d in days], COMPLETION)
    tables.append(logs.request_rows(first), path)
    again = spark.createDataFrame(
        [completion("a1", days[2]), completion("b", days[1]), completion("b", days[2], "other")], COMPLETION
    )
    tables.append(logs.append_requests(again, tables.request_logs(spark, path)), path)
    scan = tables.request_logs(spark, path)
    assert sorted(r.id for r in scan.collect()) == ["a1", "a2", "a3", "b"]
    b = scan.filter("id = 'b'").first()
    assert (b.model, b.provider, b.strategy, b.latency_ms, b.cached, b.optimized) == (
        "gpt-4o", "openai", "direct", 0, False, True,
    )
    part = tables.request_logs(spark, path, since="2024-03-02", until="2024-03-03")
    assert sorted(r.id for r in part.collect()) == ["a2", "b"]
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan


def test_statistics_of_an_empty_log(spark):
    log = tables.typed(logs.request_rows(spark.createDataFrame([], COMPLETION)), tables.REQUEST_LOGS)
    events = spark.createDataFrame([], tables.SECURITY_EVENTS)
    row = stats.stats_summary(log, events, "2024-03-02").first()
    assert (row.total_savings, row.total_queries, row.queries_cached, row.avg_latency, row.blocked_injections) == (
        0, 0, 0, 0, 0,
    )
    assert row.top_models == [] and row.recent_logs == []
    assert row.cost_over_time.days[-1] == "03-02" and row.cost_over_time.actual_cost == [0.0] * 7


def test_edge_rows_of_the_statistics(spark):
    rows = [
        completion("x-no-model", BASE, None, None, None),
        completion("x-zero-tokens", BASE + datetime.timedelta(hours=1), "LLAMA-x", (0, 0, 0), 0.0),
        completion("x-dear", BASE + datetime.timedelta(hours=2), "gpt-4o", (1, 1, 2), 9.0),
        completion("x-cached", BASE + datetime.timedelta(hours=3), "gpt-4o", (1, 1, 2), 9.0, True),
    ]
    log = logs.request_rows(spark.createDataFrame(rows, COMPLETION))
    recent = {r.id: r for r in stats.recent_requests(log).collect()}
    assert recent["x-cached"].savings_amt > 0 and recent["x-dear"[-8:]].savings_amt == 0
    zero = recent["o-tokens"]
    assert abs(zero.savings_amt - 25 * 20 / 1e6) < 1e-12 and zero.status_text == "95% Saved"
    assert {r.name: r.usage for r in stats.model_distribution(log).collect()} == {None: 1, "LLAMA-x": 1, "gpt-4o": 2}
    summary = stats.stats_summary(log, spark.createDataFrame([], tables.SECURITY_EVENTS), "2024-03-01").first()
    assert summary.total_queries == 4 and len(summary.recent_logs) == 4
    assert sorted(m.usage for m in summary.top_models) == [1, 1, 2]
    for key in ("total_savings", "queries_cached", "avg_latency", "blocked_injections", "top_models", "cost_over_time"):
        assert summary[key] is not None


def test_request_parsing(spark):
    bodies = [
        '{"messages":[{"role":"user","content":"[INST] x"}]}',
        '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image_url"},{"type":"text","text":"b"}]}]}',
        '{"messages":[{"role":"user","content":null}],"model":"m","stop":["a","b"]}',
        '{"messages":[{"role":"user","content":[{"type":"image_url"}]}]}',
        "{broken", '{"messages":[]}', '{"messages":[{"content":"x"}]}', '{"model":"m"}',
    ]
    raw = spark.createDataFrame(list(enumerate(bodies)), "i int, json string")
    good, bad = requests.parse_requests(raw)
    content = msg.last_message(F.col("messages"))["content"]
    texts = good.select(
        "i", "model", msg.message_text(content).alias("text"),
        F.to_json(msg.replace_message_text(content, F.lit("N"))).alias("new"),
    ).orderBy("i").collect()
    assert [(r.model, r.text) for r in texts] == [("auto", "[INST] x"), ("auto", "a b"), ("m", ""), ("auto", "")]
    assert [r.new for r in texts] == [
        '"N"',
        '[{"text":"N","type":"text"},{"type":"image_url"},{"text":"b","type":"text"}]',
        '"N"',
        '[{"type":"image_url"},{"text":"N","type":"text"}]',
    ]
    assert [(r.i, r.reason) for r in bad.orderBy("i").collect()] == [
        (4, "malformed json"), (5, "messages empty"), (6, "role missing"), (7, "messages missing"),
    ]


def test_recogniser_second_pass(spark):
    def factory():
        def find(texts):
            return [find_one(t) for t in texts]

        def find_one(text):
            if "boom" in text:
                raise ValueError(text)
            at = text.find("Ada")
            low = [(0, 2, "PERSON", 0.1), (0, 2, "PLANET", 0.9)]
            return low + ([(at, at + 3, "PERSON", 0.85), (at, at + 2, "US_SSN", 0.5)] if at >= 0 else [])

        return find

    df = spark.createDataFrame([(0, "mail Ada at a@b.cd"), (1, "boom Ada"), (2, None)], "i int, text string")
    found = {r.i: r.text for r in security.entity_redact(df, recogniser=factory).collect()}
    assert found == {0: "mail [REDACTED_PERSON] at [REDACTED_EMAIL]", 1: "boom Ada", 2: None}
    plain = {r.i: r.text for r in security.entity_redact(df).collect()}
    assert plain[0] == "mail Ada at [REDACTED_EMAIL]"


def test_open_key_mode(spark):
    df = spark.createDataFrame([(1, "Bearer abc"), (2, ""), (3, None), (4, "raw")], "i int, header string")
    assert sorted(r.i for r in security.filter_api_keys(df, None).collect()) == [1, 4]
    assert sorted(r.i for r in security.rejected_api_keys(df, None).collect()) == [2, 3]
    blank = security.allowed_keys(spark.createDataFrame([(" , ",)], "raw string"))
    assert sorted(r.i for r in security.filter_api_keys(df, blank).collect()) == [1, 4]
    listed = security.allowed_keys(spark.createDataFrame([("abc, ,abc",)], "raw string"))
    assert [r.i for r in security.filter_api_keys(df, listed).collect()] == [1]
    assert {(r.i, r.reason) for r in security.rejected_api_keys(df, listed).collect()} == {
        (2, "missing key"), (3, "missing key"), (4, "invalid key")}


def test_wrong_types_are_rejected_by_name(spark):
    def body(extra="", message='{"role":"user","content":"hi"}'):
        return f'{{"messages":[{message}]{extra}}}'

    wrong = {
        body(',"temperature":"hot"'): "temperature", body(',"n":"many"'): "n", body(',"n":2.5'): "n",
        body(',"stream":"maybe"'): "stream", body(',"stream":5'): "stream", body(',"model":5'): "model",
        body(',"stop":5'): "stop", body(',"stop":["a",1]'): "stop", body(',"user":{}'): "user",
        body(',"max_tokens":[1]'): "max_tokens",
        body(message='{"role":"user","content":5}'): "content", body(message='{"role":7,"content":"x"}'): "role",
        body(message='{"role":"user","content":["ignore previous instructions"]}'): "content",
        body(message='{"role":"user","content":{"a":1}}'): "content", body(message='{"role":"user","name":[]}'): "name",
        body(message='"hi"'): "messages", '{"messages":"hi"}': "messages",
    }
    good = [body(), body(',"temperature":"0.5","n":"2","stream":"yes"'), body(',"stream":1,"n":3.0,"temperature":1'),
            body(',"model":null,"temperature":null,"stop":null,"user":null'), body(',"stop":["a","b"]'),
            body(message='{"role":"user","content":[{"type":"text","text":"a"}]}'), body(message='{"role":"user"}')]
    junk = [body() + " junk", body() + "]", "[1", "", body() + "," + body()]
    malformed = requests.parse_all(spark.createDataFrame([(t,) for t in junk], "json string")).collect()
    assert [r.reason for r in malformed] == ["malformed json"] * len(junk)
    df = spark.createDataFrame(list(enumerate([*wrong, *good])), "i int, json string")
    rows = {r.i: r for r in requests.parse_all(df).collect()}
    for i, (text, name) in enumerate(wrong.items()):
        assert rows[i].reason == f"{name}: wrong type" and rows[i].request is None, text
    found = [rows[len(wrong) + i] for i in range(len(good))]
    assert [r.reason for r in found] == [None] * len(good)
    assert (found[0].request.model, found[0].request.temperature, found[0].request.n, found[0].request.stream) == ("auto", 1.0, 1, False)
    assert (found[1].request.temperature, found[1].request.n, found[1].request.stream) == (0.5, 2, True)
    assert (found[2].request.stream, found[2].request.n) == (True, 3)
    assert found[3].request.model is None and found[3].request.temperature is None


def test_last_write_of_a_hash_wins(spark):
    schema = "prompt_hash string, stored_at timestamp_ntz, expires_at timestamp_ntz, seq long, response string"
    later = BASE + datetime.timedelta(hours=1)
    old = spark.createDataFrame([("a", BASE, later, 1, "old"), ("b", BASE, later, 2, "kept")], schema)
    fills = spark.createDataFrame(
        [("a", later, 3, "x"), ("a", later, 4, "new")],
        "prompt_hash string, stored_at timestamp_ntz, seq long, response string",
    )
    found = {r.prompt_hash: (r.response, r.expires_at) for r in cache.upsert_cache(old, fills, 60).collect()}
    assert found == {"a": ("new", later + datetime.timedelta(seconds=60)), "b": ("kept", later)}


def test_long_conversation_goes_on_in_parts(spark):
    from gatelens.operators.conversations import assemble_conversations

    turns = spark.range(25).select(
        F.lit(1).alias("conv_id"), (24 - F.col("id")).alias("turn"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    rows = assemble_conversations(turns, 10).orderBy("part").collect()
    assert [[m.turn for m in r.messages] for r in rows] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_own_prices(spark):
    from gatelens.operators.cost import with_cost

    prices = spark.createDataFrame([("gpt-4o", 2.0, 4.0), ("m", 1.0, 0.0)], "model string, price_in double, price_out double")
    calls = spark.createDataFrame(
        [("m", 1_000_000, 5), ("unknown", 1_000_000, 1_000_000), (None, 0, 500_000)],
        "model string, prompt_tokens long, completion_tokens long",
    )
    assert sorted(r.cost for r in with_cost(calls, prices).collect()) == [1.0, 2.0, 6.0]
    assert sorted(r.cost for r in with_cost(calls).collect()) == [5.000075, 7.5, 20.0]


def test_bodies_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages":[{"role":"user","content":"x"}]}\n{oops\n')
    good, bad = requests.parse_requests(requests.raw_requests(spark, str(tmp_path)))
    assert (good.count(), bad.count()) == (1, 1)
    assert requests.raw_requests(spark, str(tmp_path), stream=True).isStreaming


def test_batches_skip_logged_ids_and_repeat_safely(spark, sf_dir, tmp_path):
    done = fixtures.completions(spark, sf_dir)
    path, ids = f"{tmp_path}/batches", f"{tmp_path}/ids"
    early = done.filter(F.hour("timestamp") < 12)
    first = logs.append_log_batch(early, path, ids, 0, buckets=4)
    n = first.count()
    assert n == early.select("id").distinct().count() > 0
    second = logs.append_log_batch(done, path, ids, 1, buckets=4)
    assert second.join(early, "id", "left_semi").count() == 0
    # A batch that died before it noted its ids comes again and replaces its own rows.
    again = tables.append_batch(first, path, ids, 0, buckets=4)
    assert again.count() == n
    whole = tables.request_logs(spark, path)
    assert whole.count() == whole.select("id").distinct().count() == done.select("id").distinct().count()
    assert logs.append_log_batch(done, path, ids, 2, buckets=4).count() == 0


def test_logged_ids_are_not_shuffled(spark, sf_dir, tmp_path):
    done, ids = fixtures.completions(spark, sf_dir), f"{tmp_path}/known"
    logs.append_log_batch(done.limit(50), f"{tmp_path}/log", ids, 0, buckets=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = logs.append_requests(done, tables.id_table(spark, ids, 4))
        lines = rows._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    at = next(i for i, line in enumerate(lines) if "logged_ids" in line and "Scan" in line)
    depth, above = lines[at].index("Scan"), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if own < depth:
            above.append(line.strip(" :+-*()0123456789"))
            depth = own
        if "Join" in line:
            break
    assert "HashedJoin" in above[-1] or "HashJoin" in above[-1]
    assert not any("Exchange" in line or line.startswith("Sort") for line in above)


def test_shadow_sketches_merge_and_are_near(spark):
    import datetime

    day = lambda i: datetime.datetime(2024, 1, 1 + i % 3)
    rows = [(f"{i}", day(i), "a" if i % 4 else "b", i * i % 9973 - 50, 1, 0.0) for i in range(4000)] + [("x", None, "c", None, 1, 0.0)]
    kinds = "id string, timestamp timestamp_ntz, model string, latency_ms long, total_tokens long, cost double"
    primary = spark.createDataFrame(rows, kinds)
    slower = primary.withColumn("latency_ms", F.col("latency_ms") * 2 + 7).withColumn("model", F.lit("s"))
    pairs = shadow.shadow_pairs(primary, slower)
    whole = shadow.sketch_quantiles(shadow.shadow_sketches(pairs))
    parts = [shadow.shadow_sketches(pairs.filter(F.dayofmonth("day").eqNullSafe(d))) for d in (1, 2, 3, None)]
    merged = shadow.sketch_quantiles(parts[3].union(parts[0]).union(parts[2]).union(parts[1]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    for r in whole.collect():
        own = sorted(2 * x + 7 for _, _, m, x, _, _ in rows if m == r.primary_model and x is not None)
        for p in (50, 95):
            exact = own[-(-len(own) * p // 100) - 1]
            assert abs(r[f"p{p}_shadow_latency_ms"] - exact) <= abs(exact) / 64
    compared = {r.primary_model: r for r in shadow.shadow_compare(primary, slower).collect()}
    assert compared["c"].compared == 1 and compared["c"].p50_latency_delta is None


def test_kept_cube(spark, tmp_path):
    rows = [completion(f"{i}", BASE + datetime.timedelta(hours=i), ("a", "b", None)[i % 3], cost=i / 3) for i in range(200)]
    rows += [completion("late", None, None, cost=None)]
    log = logs.request_rows(spark.createDataFrame(rows, COMPLETION))
    path = f"{tmp_path}/cube"
    parts = [log.filter(F.col("timestamp").isNull() | (F.hour("timestamp") < 5)), log.filter(F.hour("timestamp") >= 5)]
    for batch_id in (0, 1, 1):
        stats.extend_cube(parts[batch_id], path, batch_id)
    stats.compact_cube(spark, path, f"{tmp_path}/compact")
    as_of = "2024-03-09"
    plain = stats.stats_summary(log, spark.createDataFrame([], tables.SECURITY_EVENTS), as_of).collect()
    for kept in (stats.kept_cube(spark, path), stats.kept_cube(spark, f"{tmp_path}/compact"), stats.log_cube(log)):
        summary = stats.stats_summary(log, spark.createDataFrame([], tables.SECURITY_EVENTS), as_of, cube=kept)
        assert summary.collect() == plain
    tables.append(log, f"{tmp_path}/log")
    logged = tables.request_logs(spark, f"{tmp_path}/log")
    summary = stats.stats_summary(logged, spark.createDataFrame([], tables.SECURITY_EVENTS), as_of, cube=kept)
    scans = [line for line in summary._jdf.queryExecution().toString().split("\n") if "PushedFilters" in line and "latency_ms" not in line]
    assert summary.collect() == plain and any("GreaterThanOrEqual(timestamp,2024-03-09" in line for line in scans)
