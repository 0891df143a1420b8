"""Cached answers as event lines."""

from __future__ import annotations

import json

from gatelens.operators import logs, streams


def test_lines_assemble_to_the_text(spark):
    texts = {1: "one two three four five six", 2: "", 3: None, 4: 'say "é\\n"\n\u2028 \x01 end', 5: " a  b " * 40, 6: "x " * 9 + "y"}
    rows = [(i, 1704067200 + i, "gpt-4o" if i % 2 else None, t) for i, t in texts.items()]
    lines = streams.replay_lines(spark.createDataFrame(rows, "stream_id long, created long, model string, text string"))
    found = {i: [] for i in texts}
    for r in lines.orderBy("stream_id", "seq").collect():
        assert r.seq == len(found[r.stream_id])
        found[r.stream_id].append(r.line)
    for i, own in found.items():
        assert own[-1] == "data: [DONE]" and all(line.startswith("data: {") for line in own[:-1])
        events = [json.loads(line[6:]) for line in own[:-1]]
        assert "".join(e["choices"][0]["delta"]["content"] for e in events) == (texts[i] or "")
        assert {e["id"] for e in events} == {f"chatcmpl-{i}"} and {e["created"] for e in events} == {1704067200 + i}
        assert {e["model"] for e in events} == {"gpt-4o" if i % 2 else "cached-model"}
        assert all(e["object"] == "chat.completion.chunk" and e["choices"][0]["finish_reason"] is None for e in events)
    parts = streams.deltas(lines)
    again = {r.stream_id: r.text for r in streams.assemble_streams(parts).collect()}
    assert again == {i: t for i, t in texts.items() if t}


def test_cached_rows_may_cost_nothing(spark):
    usage = "usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>"
    rows = [("a", "gpt-4o", None, (1, 2, 3), 0.5, None, None, True, None), ("b", "gpt-4o", None, None, 0.25, None, 7, None, None)]
    new = spark.createDataFrame(
        rows,
        f"id string, model string, provider string, {usage}, estimated_cost double, strategy string, latency_ms long,"
        " cached boolean, optimized boolean",
    ).selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' AS timestamp")
    assert {r.id: r.cost for r in logs.request_rows(new).collect()} == {"a": 0.5, "b": 0.25}
    assert {r.id: r.cost for r in logs.request_rows(new, "zero").collect()} == {"a": 0.0, "b": 0.25}
    none = logs.request_rows(new).limit(0)
    assert {r.id: r.cost for r in logs.append_requests(new, none, "zero").collect()} == {"a": 0.0, "b": 0.25}
