"""Queries over requests, responses and the request log (scans, parsing, appends)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions import messages as msg
from gatelens.functions import sse
from gatelens.operators import conversations, logs, providers, streams
from gatelens.plans import fixtures as fx
from gatelens.plans.fixture_sql import cost, quote, with_ctes
from gatelens.session import fresh_path
from gatelens.sources import requests as req
from gatelens.sources import tables

SINCE, UNTIL = "2024-01-10", "2024-01-25"


def request_log_scan(spark, sf):
    rows = tables.typed(fx.request_logs(spark, sf), tables.REQUEST_LOGS)
    return tables.between(rows, SINCE, UNTIL).withColumn("cost", F.round("cost", 9))


def security_event_scan(spark, sf):
    from gatelens.plans.security import security_event_table

    return tables.between(
        tables.typed(security_event_table(spark, sf), tables.SECURITY_EVENTS), "2024-01-01 00:02:00"
    )


def request_log_append(spark, sf):
    done = fx.completions(spark, sf)
    # Half of the day was already logged: what came in before noon.
    logged = logs.request_rows(done).filter(F.hour("timestamp") < 12)
    return logs.append_requests(done, logged)


def request_log_append_batches(spark, sf):
    """The same as two batches of a log that keeps its ids bucketed; the second batch as written."""
    done = fx.completions(spark, sf)
    log, ids = fresh_path(spark, "log"), fresh_path(spark, "logged-ids")
    logs.append_log_batch(done.filter(F.hour("timestamp") < 12), log, ids, 0, buckets=8)
    return logs.append_log_batch(done, log, ids, 1, buckets=8)


def security_event_append(spark, sf):
    from gatelens.plans.security import security_event_table

    return security_event_table(spark, sf)


def chat_request_parse(spark, sf):
    parsed = req.parse_all(fx.chat_requests(spark, sf))
    r = F.col("request")
    return parsed.select(
        "request_id",
        "reason",
        r["model"].alias("model"),
        F.size(r["messages"]).cast("long").alias("n_messages"),
        r["temperature"].alias("temperature"),
        r["top_p"].alias("top_p"),
        r["n"].alias("n"),
        r["stream"].alias("stream"),
        F.to_json(r["stop"]).alias("stop"),
        r["max_tokens"].alias("max_tokens"),
        r["presence_penalty"].alias("presence_penalty"),
        r["user"].alias("user"),
    )


def _parsed_messages(spark, sf):
    good, _ = req.parse_requests(fx.chat_requests(spark, sf))
    return good.select("request_id", F.posexplode("messages").alias("pos", "m"))


def message_text(spark, sf):
    return _parsed_messages(spark, sf).select(
        "request_id",
        F.col("pos").cast("long").alias("pos"),
        F.col("m.role").alias("role"),
        msg.message_text(F.col("m.content")).alias("text"),
    )


def message_text_replace(spark, sf):
    new = F.concat(F.lit("new "), F.col("request_id").cast("string"))
    changed = msg.replace_message_text(F.col("m.content"), new)
    return _parsed_messages(spark, sf).select(
        "request_id",
        F.col("pos").cast("long").alias("pos"),
        msg.message_text(changed).alias("text"),
        F.coalesce(F.size(F.try_variant_get(changed, "$", "array<variant>")), F.lit(0))
        .cast("long")
        .alias("blocks"),
    )


def last_message(spark, sf):
    good, _ = req.parse_requests(fx.chat_requests(spark, sf))
    last = msg.last_message(F.col("messages"))
    return good.select(
        "request_id", last["role"].alias("role"), msg.message_text(last["content"]).alias("text")
    )


def conversation_assemble(spark, sf):
    assembled = conversations.assemble_conversations(fx.conversations(spark, sf))
    return assembled.select(
        "conv_id",
        F.size("messages").cast("long").alias("turns"),
        F.array_join(
            F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n"
        ).alias("history"),
    )


def sse_delta_parse(spark, sf):
    return streams.deltas(fx.sse_lines(spark, sf))


def provider_event_delta_parse(spark, sf):
    line = F.col("line")
    return (
        fx.provider_event_lines(spark, sf)
        .select(
            "stream_id",
            "seq",
            sse.provider_event_delta(line).alias("delta"),
            sse.provider_event_done(line).alias("done"),
        )
        .filter(F.col("delta").isNotNull() | F.col("done"))
    )


def stream_text_assemble(spark, sf):
    return streams.assemble_streams(streams.deltas(fx.sse_lines(spark, sf)))


def stream_completion_record(spark, sf):
    finished = stream_text_assemble(spark, sf).join(fx.stream_requests(spark, sf), "stream_id")
    return streams.stream_records(finished).withColumn(
        "estimated_cost", F.round("estimated_cost", 9)
    )


def response_rechunk(spark, sf):
    answers = fx.conversations(spark, sf).filter(F.col("role") == "assistant")
    return streams.rechunk(
        answers.select((F.col("conv_id") * 100 + F.col("turn")).alias("stream_id"), "text")
    )


def response_event_lines(spark, sf):
    """Cached answers as event lines; every fourth does not name its model."""
    answers = fx.conversations(spark, sf).filter(F.col("role") == "assistant")
    stream = F.col("conv_id") * 100 + F.col("turn")
    return streams.replay_lines(
        answers.select(
            stream.alias("stream_id"),
            (stream + 1704067200).alias("created"),
            F.when(stream % 4 > 0, "gpt-4o").alias("model"),
            "text",
        )
    )


def provider_request_normalize(spark, sf):
    good, _ = req.parse_requests(fx.chat_requests(spark, sf))
    return providers.normalize_request(good).select(
        "request_id",
        "model",
        "system",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(
            F.transform(
                "messages", lambda m: F.concat(m["role"], F.lit(": "), msg.message_text(m["content"]))
            ),
            "\n",
        ).alias("history"),
        "max_tokens",
        "temperature",
        F.array_join("stop_sequences", "|").alias("stop_sequences"),
    )


def provider_response_normalize(spark, sf):
    choice = F.col("choices")[0]
    return providers.normalize_response(fx.message_responses(spark, sf)).select(
        "response_id",
        "id",
        "object",
        "created",
        "model",
        choice["message"]["role"].alias("role"),
        choice["message"]["content"].alias("content"),
        choice["finish_reason"].alias("finish_reason"),
        "usage.prompt_tokens",
        "usage.completion_tokens",
        "usage.total_tokens",
    )


def usage_extract(spark, sf):
    return fx.completion_responses(spark, sf).select("id", logs.usage(F.struct("usage")).alias("u")).select(
        "id", "u.*"
    )


def unified_usage_union(spark, sf):
    return providers.unify_usage(
        fx.completion_responses(spark, sf),
        providers.normalize_response(fx.message_responses(spark, sf)),
    )


QUERIES = {
    f.__name__: f
    for f in (
        request_log_scan,
        security_event_scan,
        request_log_append,
        request_log_append_batches,
        security_event_append,
        chat_request_parse,
        message_text,
        message_text_replace,
        last_message,
        conversation_assemble,
        sse_delta_parse,
        provider_event_delta_parse,
        stream_text_assemble,
        stream_completion_record,
        response_rechunk,
        response_event_lines,
        provider_request_normalize,
        provider_response_normalize,
        usage_extract,
        unified_usage_union,
    )
}



def _tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, {quote(cfg.PRETOKEN_PATTERN)}))"


_K = "(props->>'$.k')::BIGINT"
_MODEL = (
    "(CASE event_type WHEN 'signup' THEN 'gpt-4o' WHEN 'view' THEN 'llama-3.1-8b-instant' "
    "WHEN 'click' THEN 'gpt-3.5-turbo' WHEN 'purchase' THEN 'llama-3.3-70b-versatile' "
    "ELSE 'unlisted-model' END)"
)
_COMPLETIONS = f"""
    SELECT 'cmpl-' || (event_id - CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END) AS id, ts AS timestamp,
      {_MODEL} AS model, CASE WHEN event_id % 5 = 0 THEN 'groq' ELSE 'openai' END AS provider,
      CASE WHEN event_id % 4 <> 1 THEN {_K} ELSE 0 END AS prompt_tokens,
      CASE WHEN event_id % 4 <> 1 AND event_id % 8 <> 2 THEN floor(value)::BIGINT ELSE 0 END AS completion_tokens,
      CASE WHEN event_id % 4 <> 1 THEN {_K} + floor(value)::BIGINT ELSE 0 END AS total_tokens,
      CASE WHEN event_id % 6 <> 0 THEN value / 1000 ELSE 0.0 END::DOUBLE AS cost,
      CASE WHEN event_id % 7 <> 0 THEN 'balanced_performance' ELSE 'direct' END AS strategy,
      CASE WHEN event_id % 9 <> 0 THEN event_id % 1000 ELSE 0 END::BIGINT AS latency_ms,
      CASE WHEN event_id % 10 <> 0 THEN event_id % 2 = 0 ELSE false END AS cached,
      CASE WHEN event_id % 11 <> 0 THEN false ELSE true END AS optimized
    FROM events"""
_LOG_COLUMNS = (
    "id, timestamp, model, provider, prompt_tokens, completion_tokens, total_tokens, cost, strategy, "
    "latency_ms, cached, optimized"
)

SQL = {
    "request_log_scan": f"""
        SELECT {_LOG_COLUMNS.replace(" cost,", " round(cost, 9) AS cost,")} FROM fx_request_logs
        WHERE timestamp >= TIMESTAMP '{SINCE}' AND timestamp < TIMESTAMP '{UNTIL}'""",
    "security_event_scan": """
        SELECT * FROM fx_security_events WHERE timestamp >= TIMESTAMP '2024-01-01 00:02:00'""",
    "request_log_append": f"""
        WITH completions AS ({_COMPLETIONS})
        SELECT {_LOG_COLUMNS} FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp) AS rn FROM completions
          WHERE id NOT IN (SELECT id FROM completions WHERE hour(timestamp) < 12)) WHERE rn = 1""",
    "request_log_append_batches": f"""
        WITH completions AS ({_COMPLETIONS})
        SELECT {_LOG_COLUMNS} FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp) AS rn FROM completions
          WHERE id NOT IN (SELECT id FROM completions WHERE hour(timestamp) < 12)) WHERE rn = 1""",
    "security_event_append": "SELECT * FROM fx_security_events",
    "chat_request_parse": """
        SELECT request_id, reason,
          CASE WHEN reason IS NULL THEN coalesce(j->>'$.model', 'auto') END AS model,
          CASE WHEN reason IS NULL THEN json_array_length(j, '$.messages')::BIGINT END AS n_messages,
          CASE WHEN reason IS NULL THEN coalesce((j->>'$.temperature')::DOUBLE, 1.0::DOUBLE) END AS temperature,
          CASE WHEN reason IS NULL THEN 1.0::DOUBLE END AS top_p,
          CASE WHEN reason IS NULL THEN coalesce((j->>'$.n')::INTEGER, 1) END AS n,
          CASE WHEN reason IS NULL THEN coalesce((j->>'$.stream')::BOOLEAN, false) END AS stream,
          CASE WHEN reason IS NULL AND json_type(j, '$.stop') <> 'NULL'
            THEN json_extract(j, '$.stop')::VARCHAR END AS stop,
          CASE WHEN reason IS NULL THEN (j->>'$.max_tokens')::INTEGER END AS max_tokens,
          CASE WHEN reason IS NULL THEN 0.0::DOUBLE END AS presence_penalty,
          CASE WHEN reason IS NULL THEN j->>'$.user' END AS "user"
        FROM (SELECT *, CASE WHEN reason IS NULL THEN json END AS j FROM fx_parsed)""",
    "message_text": "SELECT request_id, pos, role, text FROM fx_message_text",
    "message_text_replace": """
        SELECT request_id, pos,
          CASE coalesce(json_type(content), 'NULL') WHEN 'ARRAY' THEN
            'new ' || request_id || CASE WHEN (content->>'$[1].type') = 'text' THEN ' ' || (content->>'$[1].text') ELSE '' END
            ELSE 'new ' || request_id END AS text,
          CASE WHEN json_type(content) = 'ARRAY' THEN json_array_length(content)::BIGINT
            + CASE WHEN (content->>'$[0].type') = 'text' THEN 0 ELSE 1 END ELSE 0 END::BIGINT AS blocks
        FROM fx_messages""",
    "last_message": "SELECT request_id, role, text FROM fx_message_text WHERE pos = n - 1",
    "conversation_assemble": """
        SELECT conv_id, count(*)::BIGINT AS turns,
          string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
        FROM conversations GROUP BY conv_id""",
    "sse_delta_parse": "SELECT stream_id, seq, delta FROM fx_deltas",
    "provider_event_delta_parse": """
        SELECT stream_id, seq, word AS delta, false AS done FROM fx_words WHERE word <> ''
        UNION ALL SELECT stream_id, 1000000, NULL, true FROM fx_answers""",
    "stream_text_assemble": "SELECT * FROM fx_streams",
    "stream_completion_record": f"""
        WITH counted AS (
          SELECT s.stream_id, s.text, {_tokens("'turn ' || a.turn || ' of ' || a.text")}::BIGINT AS prompt_tokens,
            {_tokens("s.text")}::BIGINT AS completion_tokens,
            CASE WHEN s.stream_id % 2 = 0 THEN 'gpt-4o' ELSE 'llama-3.1-8b-instant' END AS model
          FROM fx_streams s JOIN fx_answers a ON a.stream_id = s.stream_id)
        SELECT 'stream-' || stream_id AS id, model, prompt_tokens, completion_tokens,
          prompt_tokens + completion_tokens AS total_tokens, round({cost()}, 9) AS estimated_cost,
          'balanced_performance' AS strategy, stream_id % 900 AS latency_ms, false AS cached, true AS optimized,
          left(text, 200) || '...' AS content, text
        FROM counted""",
    "response_rechunk": """
        SELECT stream_id, (c.i // 5)::INTEGER AS chunk_no,
          array_to_string(words[c.i + 1 : c.i + 5], ' ') || CASE WHEN c.i + 5 < len(words) THEN ' ' ELSE '' END AS chunk
        FROM (SELECT stream_id, string_split(text, ' ') AS words FROM fx_answers) a,
          LATERAL (SELECT unnest(range(0, len(a.words), 5)) AS i) c""",
    "response_event_lines": """
        SELECT stream_id, (c.i // 5)::INTEGER AS seq, CASE WHEN c.i >= len(words) THEN 'data: [DONE]' ELSE
          'data: ' || json_object('id', 'chatcmpl-' || stream_id, 'object', 'chat.completion.chunk', 'created', stream_id + 1704067200,
            'model', CASE WHEN stream_id % 4 > 0 THEN 'gpt-4o' ELSE 'cached-model' END, 'choices', json_array(json_object('index', 0,
              'delta', json_object('content', array_to_string(words[c.i + 1 : c.i + 5], ' ') || CASE WHEN c.i + 5 < len(words) THEN ' ' ELSE '' END),
              'finish_reason', NULL)))::VARCHAR END AS line
        FROM (SELECT stream_id, string_split(text, ' ') AS words FROM fx_answers) a,
          LATERAL (SELECT unnest(range(0, len(a.words) + 5, 5)) AS i) c""",
    "provider_request_normalize": """
        SELECT t.request_id, coalesce(first(p.json->>'$.model'), 'auto') AS model,
          nullif(trim(coalesce(string_agg(t.text, chr(10) ORDER BY t.pos) FILTER (t.role = 'system'), ''),
            ' ' || chr(9) || chr(10) || chr(13)), '') AS system,
          count(*) FILTER (t.role <> 'system')::BIGINT AS n_messages,
          coalesce(string_agg(t.role || ': ' || t.text, chr(10) ORDER BY t.pos) FILTER (t.role <> 'system'), '') AS history,
          coalesce(first((p.json->>'$.max_tokens')::INTEGER), 4096) AS max_tokens,
          coalesce(first((p.json->>'$.temperature')::DOUBLE), 1.0::DOUBLE) AS temperature,
          first(CASE json_type(p.json, '$.stop') WHEN 'ARRAY' THEN array_to_string((p.json->'$.stop')::VARCHAR[], '|')
            WHEN 'VARCHAR' THEN p.json->>'$.stop' END) AS stop_sequences
        FROM fx_message_text t JOIN fx_parsed p ON p.request_id = t.request_id
        GROUP BY t.request_id""",
    "provider_response_normalize": """
        SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM (
          SELECT r AS response_id, CASE WHEN r % 5 <> 0 THEN 'msg_' || r ELSE 'msg_unknown' END AS id,
            'chat.completion' AS object, 0::BIGINT AS created, 'claude-3-5-sonnet-20241022' AS model,
            'assistant' AS role, CASE WHEN r % 7 <> 0 THEN text || ' #' || orig_role ELSE '' END AS content,
            CASE WHEN r % 2 = 0 THEN 'end_turn' ELSE 'stop' END AS finish_reason,
            CASE WHEN r % 4 <> 0 THEN length(text) ELSE 0 END::BIGINT AS prompt_tokens,
            CASE WHEN r % 4 <> 0 AND r % 3 <> 0 THEN turn * 10 ELSE 0 END::BIGINT AS completion_tokens
          FROM (SELECT conv_id * 100 + turn AS r, turn, text, role AS orig_role FROM conversations))""",
    "usage_extract": f"""
        SELECT 'chat-' || event_id AS id, CASE WHEN event_id % 6 <> 0 THEN {_K} ELSE 0 END AS prompt_tokens,
          CASE WHEN event_id % 6 <> 0 THEN floor(value)::BIGINT ELSE 0 END AS completion_tokens,
          CASE WHEN event_id % 6 <> 0 THEN {_K} + floor(value)::BIGINT ELSE 0 END AS total_tokens FROM events""",
    "unified_usage_union": f"""
        SELECT 'chat-' || event_id AS id, {_MODEL} AS model,
          CASE WHEN event_id % 6 <> 0 THEN {_K} ELSE 0 END AS prompt_tokens,
          CASE WHEN event_id % 6 <> 0 THEN floor(value)::BIGINT ELSE 0 END AS completion_tokens,
          CASE WHEN event_id % 6 <> 0 THEN {_K} + floor(value)::BIGINT ELSE 0 END AS total_tokens FROM events
        UNION ALL
        SELECT id, 'claude-3-5-sonnet-20241022', i, o, i + o FROM (
          SELECT CASE WHEN r % 5 <> 0 THEN 'msg_' || r ELSE 'msg_unknown' END AS id,
            CASE WHEN r % 4 <> 0 THEN length(text) ELSE 0 END::BIGINT AS i,
            CASE WHEN r % 4 <> 0 AND r % 3 <> 0 THEN turn * 10 ELSE 0 END::BIGINT AS o
          FROM (SELECT conv_id * 100 + turn AS r, turn, text FROM conversations))""",
}
SQL = {key: with_ctes(text) for key, text in SQL.items()}
