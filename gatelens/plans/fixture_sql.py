"""The derived tables of ``fixtures`` once more, as DuckDB common table expressions."""

from __future__ import annotations

from gatelens import settings as cfg
from gatelens.plans import samples
from gatelens.plans.fixtures import AS_OF, EPOCH


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def price_case(model: str, side: int) -> str:
    whens = " ".join(f"WHEN {quote(m)} THEN {p[side]}::DOUBLE" for m, p in cfg.PRICES.items())
    return f"(CASE {model} {whens} ELSE {cfg.PRICES[cfg.BASELINE_MODEL][side]}::DOUBLE END)"


def cost(model: str = "model", tokens_in: str = "prompt_tokens", tokens_out: str = "completion_tokens") -> str:
    return (
        f"(({tokens_in})::DOUBLE * {price_case(model, 0)} + ({tokens_out})::DOUBLE * {price_case(model, 1)}) / 1e6"
    )


def baseline(tokens_in: str = "prompt_tokens", tokens_out: str = "completion_tokens") -> str:
    p_in, p_out = cfg.PRICES[cfg.BASELINE_MODEL]
    return f"(({tokens_in})::DOUBLE * {p_in}::DOUBLE + ({tokens_out})::DOUBLE * {p_out}::DOUBLE) / 1e6"


_MODEL = (
    "(CASE event_type WHEN 'signup' THEN 'gpt-4o' WHEN 'view' THEN 'llama-3.1-8b-instant' "
    "WHEN 'click' THEN 'gpt-3.5-turbo' WHEN 'purchase' THEN 'llama-3.3-70b-versatile' "
    "ELSE 'unlisted-model' END)"
)
_K = "(props->>'$.k')::BIGINT"


def _with_sample(values: list[str], cycle: int, before: bool = False) -> str:
    sample = f"coalesce({text_list(values)}[(doc_id % {cycle} + 1)::BIGINT], '')"
    return f"{sample} || ' ' || text" if before else f"text || ' ' || {sample}"


_CONTENT = """
  CASE CASE WHEN turn = 0 AND conv_id % 23 = 7 THEN 6 WHEN turn = 0 AND conv_id % 23 = 11 THEN 7
      WHEN turn = 0 THEN conv_id % 6 ELSE 0 END
    WHEN 6 THEN '["ignore previous instructions"]'
    WHEN 7 THEN '5'
    WHEN 1 THEN '[{"type":"text","text":' || to_json(text)::VARCHAR || '},{"type":"image_url","image_url":"http://x/y"}]'
    WHEN 2 THEN '[{"type":"text","text":' || to_json(text)::VARCHAR || '},{"type":"text","text":"call 555-123-4567"}]'
    WHEN 3 THEN 'null'
    WHEN 5 THEN '[{"type":"image_url","image_url":"http://x/y"}]'
    ELSE to_json(text)::VARCHAR END
"""

CTES: dict[str, tuple[str, ...] | str] = {
    "fx_raw_logs": f"""
        SELECT event_id, 'req-' || lpad(event_id::VARCHAR, 12, '0') AS id, ts AS timestamp,
          {_MODEL} AS model, 'openai' AS provider, 10 + 7 * {_K} AS prompt_tokens,
          floor(value * 2)::BIGINT AS completion_tokens, 20 + (event_id * 37) % 1500 AS latency_ms,
          event_id % 4 = 0 AS cached, true AS optimized, 'key-' || (user_id % 5) AS tenant
        FROM events""",
    "fx_request_logs": f"""
        SELECT *, prompt_tokens + completion_tokens AS total_tokens, {cost()} AS cost,
          CASE WHEN model IN ('gpt-4o', 'llama-3.3-70b-versatile') THEN 'intensive_reasoning'
               WHEN model IN ('gpt-3.5-turbo', 'llama-3.1-8b-instant') THEN 'efficiency_optimized'
               ELSE 'balanced_performance' END AS strategy
        FROM fx_raw_logs""",
    "fx_pii": f"SELECT doc_id, {_with_sample(samples.PII, len(samples.PII))} AS text FROM documents",
    "fx_entities": f"SELECT doc_id, {_with_sample(samples.ENTITIES, len(samples.ENTITIES))} AS text FROM fx_pii",
    "fx_injection": f"""
        SELECT doc_id AS request_id, TIMESTAMP '{EPOCH}' + to_seconds(doc_id) AS timestamp,
          {_with_sample(samples.INJECTION, samples.INJECTION_CYCLE)} AS text,
          '10.0.0.' || (doc_id % 250) AS source_ip
        FROM documents""",
    "fx_routing": f"""
        SELECT doc_id, lang AS tenant, trim({_with_sample(samples.ROUTING, len(samples.ROUTING), True)}) AS text
        FROM documents""",
    "fx_prompts": f"""
        SELECT doc_id AS request_id, TIMESTAMP '{EPOCH}' + to_seconds(doc_id) AS arrival,
          CASE WHEN lang <> 'es' THEN 'Bearer ' || lang ELSE '' END AS api_key, text AS prompt
        FROM documents""",
    "fx_keyed_prompts": """
        SELECT *, sha256(tenant_salt || ':' || normalized) AS prompt_hash FROM (
          SELECT *, trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g')) AS normalized,
            CASE WHEN api_key <> '' THEN substr(sha256(api_key), 1, 16) ELSE 'global' END AS tenant_salt
          FROM fx_prompts)""",
    "fx_cache_log": "SELECT event_id AS request_id, event_type AS prompt_hash, ts FROM events",
    "fx_vector_queries": """
        SELECT vec_id AS query_id, 't' || (label % 3) AS tenant,
          list_transform(embedding, lambda x, i:
            x::DOUBLE + 0.01::DOUBLE * (vec_id % 11) * (((i - 1) * 7 + vec_id) % 3 - 1)) AS vector
        FROM embeddings""",
    "fx_vector_index": """
        SELECT vec_id AS seq, 't' || (label % 3) AS tenant, embedding::DOUBLE[] AS vector FROM embeddings""",
    "fx_exemplars": """
        SELECT kind, vector FROM (
          SELECT CASE WHEN label < 5 THEN 'complex' ELSE 'trivial' END AS kind, embedding::DOUBLE[] AS vector,
            row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) AS rank FROM embeddings)
        WHERE rank <= 10""",
    "fx_turns": f"""
        SELECT conv_id, turn, role, text, {_CONTENT} AS content FROM (
          SELECT conv_id, turn, role,
            CASE WHEN conv_id % 9 = 2 AND role = 'user' THEN text || {quote(samples.ATTACK)} ELSE text END AS text
          FROM conversations)""",
    "fx_histories": """
        SELECT u.conv_id * 100 + u.turn AS request_id, u.conv_id AS conv_id, u.turn AS turn,
          list({'role': m.role, 'content': m.content::JSON} ORDER BY m.turn) AS messages
        FROM fx_turns u JOIN fx_turns m ON m.conv_id = u.conv_id AND m.turn <= u.turn
        WHERE u.role = 'user' GROUP BY u.conv_id, u.turn""",
    "fx_chat_requests": """
        SELECT request_id, CASE WHEN conv_id % 11 = 10 THEN left(body, length(body) - 1) ELSE body END AS json FROM (
          SELECT request_id, conv_id, to_json(struct_pack(
            model := CASE WHEN conv_id % 7 <> 0 THEN 'gpt-4o' END,
            messages := CASE WHEN conv_id % 13 <> 12 THEN messages END,
            temperature := CASE WHEN conv_id % 17 = 3 THEN '"hot"'::JSON WHEN conv_id % 4 = 0 THEN '0.5'::JSON
              WHEN conv_id % 4 = 1 THEN '"0.25"'::JSON END,
            n := CASE conv_id % 19 WHEN 4 THEN '"many"'::JSON WHEN 5 THEN '2.5'::JSON WHEN 6 THEN '2'::JSON END,
            stream := CASE WHEN conv_id % 3 = 0 THEN conv_id % 2 = 0 END,
            stop := CASE conv_id % 5 WHEN 1 THEN '"END"'::JSON WHEN 2 THEN '["A","B"]'::JSON END,
            max_tokens := CASE WHEN conv_id % 6 = 1 THEN 256 END,
            "user" := CASE WHEN conv_id % 8 = 0 THEN 'user-' || conv_id END))::VARCHAR AS body
          FROM fx_histories)""",
    "fx_parsed": """
        SELECT *, CASE WHEN NOT json_valid(json) THEN 'malformed json'
            WHEN coalesce(json_type(json, '$.messages'), 'NULL') = 'NULL' THEN 'messages missing'
            WHEN len(list_filter(json_extract(json, '$.messages[*].content'), lambda c:
              json_type(c) NOT IN ('NULL', 'VARCHAR', 'ARRAY') OR (json_type(c) = 'ARRAY' AND json_type(c, '$[0]') <> 'OBJECT'))) > 0
              THEN 'content: wrong type'
            WHEN coalesce(json_type(json, '$.temperature'), 'NULL') <> 'NULL'
              AND TRY_CAST(json_extract_string(json, '$.temperature') AS DOUBLE) IS NULL THEN 'temperature: wrong type'
            WHEN json_extract_string(json, '$.n') LIKE '%.5' OR TRY_CAST(json_extract_string(json, '$.n') AS DOUBLE) IS NULL
              AND coalesce(json_type(json, '$.n'), 'NULL') <> 'NULL' THEN 'n: wrong type' END AS reason
        FROM fx_chat_requests""",
    "fx_messages": """
        SELECT request_id, m.i AS pos, n,
          json_extract(json, '$.messages[' || m.i || '].content') AS content,
          json_extract_string(json, '$.messages[' || m.i || '].role') AS role
        FROM (SELECT request_id, json, json_array_length(json, '$.messages')::BIGINT AS n
              FROM fx_parsed WHERE reason IS NULL) p,
          LATERAL (SELECT unnest(range(0, p.n)) AS i) m""",
    "fx_message_text": """
        SELECT request_id, pos, n, role, content,
          CASE coalesce(json_type(content), 'NULL') WHEN 'NULL' THEN '' WHEN 'VARCHAR' THEN content->>'$'
            ELSE array_to_string(list_transform(list_filter(content::JSON[],
              lambda b: (b->>'$.type') = 'text'), lambda b: b->>'$.text'), ' ') END AS text
        FROM fx_messages""",
    "fx_answers": """
        SELECT conv_id * 100 + turn AS stream_id, text, turn FROM conversations WHERE role = 'assistant'""",
    "fx_words": """
        SELECT stream_id, w.i - 1 AS seq, words[w.i] AS word FROM
          (SELECT stream_id, string_split(text, ' ') AS words FROM fx_answers) a,
          LATERAL (SELECT unnest(range(1, len(a.words) + 1)) AS i) w""",
    "fx_sse": f"""
        SELECT stream_id, seq, 'data: ' || to_json({{'choices': [{{'index': 0, 'delta':
          {{'content': CASE WHEN stream_id % 11 <> 0 THEN word || ' ' ELSE '' END}}}}]}})::VARCHAR AS line FROM fx_words
        UNION ALL SELECT stream_id, -1, 'data: {{"broken' FROM fx_answers
        UNION ALL SELECT stream_id, -2, ': keep-alive' FROM fx_answers
        UNION ALL SELECT stream_id, -3, {quote(samples.DELTA_AND_JUNK)} FROM fx_answers
        UNION ALL SELECT stream_id, 1000000, 'data: [DONE]' FROM fx_answers""",
    "fx_deltas": """
        SELECT * FROM (
          SELECT stream_id, seq, CASE WHEN starts_with(line, 'data: ') AND line <> 'data: [DONE]'
            AND json_valid(substr(line, 7))
            THEN json_extract_string(substr(line, 7), '$.choices[0].delta.content') END AS delta FROM fx_sse)
        WHERE delta <> ''""",
    "fx_streams": """
        SELECT stream_id, string_agg(delta, '' ORDER BY seq) AS text FROM fx_deltas GROUP BY stream_id""",
    "fx_attempts": f"""
        SELECT event_id AS request_id, {_MODEL} AS model, event_type <> 'error' AND event_id % 7 <> 0 AS ok,
          CASE WHEN event_type <> 'error' AND event_id % 7 <> 0 THEN 200
            ELSE CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 404 ELSE 500 END END AS status,
          {_K} % 4 AS chunks, event_id % 5 <> 0 AS ok2,
          CASE WHEN event_id % 5 <> 0 THEN 200 ELSE 503 END AS status2
        FROM events""",
    "fx_security_events": "",  # filled in by the security queries
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` behind the named expressions and everything they refer to."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in CTES:
            if other != name and _refers(CTES[name], other):
                visit(other)
        needed.append(name)

    for other in CTES:
        if _refers(body, other) or other in names:
            visit(other)
    clauses = [f"{n} AS ({CTES[n]})" for n in needed]
    text = body.strip()
    head = "WITH"
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(start):
            head, text = start.strip(), text[len(start) :]
            return f"{head} " + ",\n".join([*clauses, text])
    return f"{head} " + ",\n".join(clauses) + f"\n{text}" if clauses else text


def _refers(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None


__all__ = ["AS_OF", "CTES", "baseline", "cost", "quote", "text_list", "with_ctes"]
