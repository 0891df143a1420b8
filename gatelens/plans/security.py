"""Queries over personal data, prompt injection and API keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.functions import injection, models, pii
from gatelens.functions import messages as msg
from gatelens.functions.once import literal_rows
from gatelens.operators import logs, security
from gatelens.plans import fixtures as fx
from gatelens.plans.fixture_sql import CTES, quote, text_list, with_ctes
from gatelens.sources import requests as req


def security_event_table(spark, sf):
    blocked, _ = security.split_blocked(fx.injection_texts(spark, sf))
    return logs.security_event_rows(blocked)


def _redacting(kind: str):
    def query(spark, sf):
        redact = getattr(pii, f"redact_{kind.lower()}")
        return fx.pii_texts(spark, sf).select("doc_id", redact(F.col("text")).alias("text"))

    return query


def pii_redact(spark, sf):
    return fx.pii_texts(spark, sf).select("doc_id", pii.redact_pii(F.col("text")).alias("text"))


def pii_redact_conversation(spark, sf):
    good, _ = req.parse_requests(fx.chat_requests(spark, sf))
    redacted = good.select("request_id", msg.redact_conversation(F.col("messages")).alias("messages"))
    return redacted.select("request_id", F.posexplode("messages").alias("pos", "m")).select(
        "request_id",
        F.col("pos").cast("long").alias("pos"),
        msg.message_text(F.col("m.content")).alias("text"),
    )


def pii_type_counts(spark, sf):
    return security.pii_type_counts(fx.pii_texts(spark, sf))


def entity_redact(spark, sf):
    return security.entity_redact(fx.entity_texts(spark, sf))


def homoglyph_normalize(spark, sf):
    return fx.injection_texts(spark, sf).select(
        "request_id", injection.normalize_homoglyphs(F.col("text")).alias("text")
    )


def base64_expand(spark, sf):
    return fx.injection_texts(spark, sf).select(
        "request_id", injection.expand_base64(F.col("text")).alias("text")
    )


def injection_detect(spark, sf):
    return security.flag_injection(fx.injection_texts(spark, sf)).select(
        "request_id", F.col("pattern").isNotNull().alias("is_injection"), "pattern"
    )


def injection_split(spark, sf):
    blocked, clean = security.split_blocked(fx.injection_texts(spark, sf))
    return blocked.select("request_id", F.lit("blocked").alias("outcome")).unionByName(
        clean.select("request_id", F.lit("clean").alias("outcome"))
    )


def blocked_injection_count(spark, sf):
    return security.blocked_count(security_event_table(spark, sf))


def api_key_filter(spark, sf):
    log = fx.api_key_log(spark, sf)
    allowed = security.allowed_keys(literal_rows(spark, ["raw"], [(fx.ALLOWED_KEYS,)]))
    return security.label_api_keys(log, allowed).select(
        "request_id", "token", F.coalesce("reason", F.lit("accepted")).alias("outcome")
    )


def api_key_preview(spark, sf):
    token = models.bearer_token(F.col("header"))
    return fx.api_key_log(spark, sf).select("request_id", models.key_preview(token).alias("preview"))


QUERIES = {
    "pii_email": _redacting("EMAIL"),
    "pii_card": _redacting("CARD"),
    "pii_ssn": _redacting("SSN"),
    "pii_aadhaar": _redacting("AADHAAR"),
    "pii_pan": _redacting("PAN"),
    "pii_phone": _redacting("PHONE"),
    **{
        f.__name__: f
        for f in (
            pii_redact,
            pii_redact_conversation,
            pii_type_counts,
            entity_redact,
            homoglyph_normalize,
            base64_expand,
            injection_detect,
            injection_split,
            blocked_injection_count,
            api_key_filter,
            api_key_preview,
        )
    },
}

# --- The same in SQL -----------------------------------------------------------
# DuckDB's regular expressions are ASCII for \w and \d and have no look-around.
# \w is spelled out; for the phone pattern each run of digits is bracketed first
# (U+E000 ... U+E001), which makes "not after a digit" and "not before a digit"
# plain characters, and a + or ( right after a digit is renamed so that no match
# can start there.
_EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
_OPEN, _CLOSE, _PLUS, _PAREN = "", "", "", ""
_PHONE = (
    rf"(?:\+?{_OPEN}\d{{1,3}}(?:{_CLOSE}[\s.-]?[({_PAREN}]?{_OPEN})?|\(?{_OPEN})"
    rf"\d{{2,4}}(?:{_CLOSE}\)?[\s.-]?{_OPEN})?\d{{3,4}}(?:{_CLOSE}[\s.-]?{_OPEN})?\d{{4,9}}{_CLOSE}"
)


def _sub(text: str, kind: str) -> str:
    tag = quote(f"[REDACTED_{kind}]")
    if kind == "PHONE":
        marked = rf"regexp_replace({text}, '(\d+)', '{_OPEN}\1{_CLOSE}', 'g')"
        marked = f"replace(replace({marked}, '{_CLOSE}+', '{_CLOSE}{_PLUS}'), '{_CLOSE}(', '{_CLOSE}{_PAREN}')"
        swapped = f"regexp_replace({marked}, {quote(_PHONE)}, {tag}, 'g')"
        return f"translate({swapped}, '{_PLUS}{_PAREN}{_OPEN}{_CLOSE}', '+(')"
    pattern = _EMAIL if kind == "EMAIL" else cfg.PII_PATTERNS[kind]
    return f"regexp_replace({text}, {quote(pattern)}, {tag}, 'g')"


def redact_sql(text: str) -> str:
    for kind in cfg.PII_PATTERNS:
        text = _sub(text, kind)
    return text


def _count_sql(kind: str) -> str:
    tag = f"[REDACTED_{kind}]"
    return f"((length(s) - length(replace(s, {quote(tag)}, ''))) // {len(tag)})"


_IBAN_CUT = "regexp_replace({}, ' [A-Z0-9]{{1,4}}$', '')"
_IBAN = """list_reduce(list_prepend(0, list_transform(string_split(substr({0}, 5) || left({0}, 4), ''), lambda c: ord(c))),
    lambda acc, c: (acc * CASE WHEN c < 58 THEN 10 ELSE 100 END + c - CASE WHEN c < 58 THEN 48 ELSE 55 END) % 97) = 1"""
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"


def _part_sql(check: str | None) -> str:
    """What of ``hit`` passes the check of its rule."""
    if check == "iban":
        cuts = ["hit", _IBAN_CUT.format("hit"), _IBAN_CUT.format(_IBAN_CUT.format("hit"))]
        valid = [f"CASE WHEN {_IBAN.format(f"replace({c}, ' ', '')")} THEN {c} END" for c in cuts]
        return f"coalesce({', '.join(valid)})"
    if check == "luhn":
        doubled = "list_transform(string_split(reverse(" + _DIGITS + "), ''), lambda c, i: c::INT * (2 - i % 2))"
        return f"CASE WHEN list_sum(list_transform({doubled}, lambda x: x // 10 + x % 10)) % 10 = 0 THEN hit END"
    if check == "ssn":
        area, group, serial = (f"substr({_DIGITS}, {at}, {n})" for at, n in ((1, 3), (4, 2), (6, 4)))
        bad = f"{area} IN ('000', '666') OR {area} >= '900' OR {group} = '00' OR {serial} = '0000'"
        return f"CASE WHEN NOT ({bad}) THEN hit END"
    return "hit"


def _rule_sql(rule: int) -> str:
    """(doc_id, start, len, score, rule, kind) of one rule's matches that stand alone and pass its check."""
    kind, pattern, score, check, words = cfg.ENTITY_RULES[rule]
    sure = 1.0 if check in ("luhn", "iban") else score
    near = f"lower(right(before, {cfg.ENTITY_CONTEXT_CHARS}))"
    spoken = " OR ".join([f"contains({near}, {quote(w)})" for w in words] or ["false"])
    boosted = min(1.0, max(sure + cfg.ENTITY_CONTEXT_BOOST, cfg.ENTITY_SCORE_THRESHOLD))
    return f"""
        SELECT doc_id, start, length(part) AS len, score, {rule} AS rule, '{kind}' AS kind FROM (
          SELECT doc_id, start, {_part_sql(check)} AS part, (CASE WHEN {spoken} THEN {boosted} ELSE {sure} END)::DOUBLE AS score FROM (
            SELECT doc_id, hit, before, after, k, n,
              (sum(length(before) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) - length(hit))::BIGINT AS start
            FROM (SELECT doc_id, hits[k] AS hit, gaps[k] AS before, gaps[k + 1] AS after, k, len(hits) AS n FROM (
              SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS k FROM (
                SELECT doc_id, regexp_extract_all(text, {quote(pattern)}) AS hits,
                  string_split_regex(text, {quote(pattern)}) AS gaps FROM redacted))))
          WHERE NOT regexp_matches(right(before, 1), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(left(after, 1), '[\\p{{L}}\\p{{N}}_]')
            AND (k = 1 OR before <> '') AND (k = n OR after <> ''))
        WHERE part IS NOT NULL AND score >= {cfg.ENTITY_SCORE_THRESHOLD}"""


_ENTITIES = f"""
    WITH redacted AS MATERIALIZED (SELECT doc_id, {redact_sql("text")} AS text FROM fx_entities),
    spans AS ({" UNION ALL ".join(_rule_sql(i) for i in range(len(cfg.ENTITY_RULES)))}),
    runs AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, start + len, rule
        ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, coalesce(max(start + len) OVER (PARTITION BY doc_id ORDER BY start, start + len, rule
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= start, true) AS fresh FROM spans)),
    merged AS (SELECT doc_id, min(start) AS start, max(start + len) AS stop,
        first(kind ORDER BY score DESC, len DESC, start, rule) AS kind FROM runs GROUP BY doc_id, run),
    placed AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since FROM merged),
    pieces AS (SELECT p.doc_id, max(p.stop) AS stop,
        string_agg(substr(r.text, p.since + 1, p.start - p.since) || '[REDACTED_' || p.kind || ']', '' ORDER BY p.start) AS head
      FROM placed p JOIN redacted r ON r.doc_id = p.doc_id GROUP BY 1)
    SELECT r.doc_id, coalesce(p.head || substr(r.text, p.stop + 1), r.text) AS text
    FROM redacted r LEFT JOIN pieces p ON p.doc_id = r.doc_id"""


_GLYPHS = f"translate(text, {quote(cfg.HOMOGLYPHS)}, {quote(cfg.HOMOGLYPH_TARGETS)})"
# Valid UTF-8 sequences of a hex dump; a byte outside any of them yields ''.
_UTF8 = (
    "([0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]"
    "|E0[AB][0-9A-F][89AB][0-9A-F]|(?:E[1-9A-CEF])[89AB][0-9A-F][89AB][0-9A-F]|ED[89][0-9A-F][89AB][0-9A-F]"
    "|F0[9AB][0-9A-F][89AB][0-9A-F][89AB][0-9A-F]|F[1-3][89AB][0-9A-F][89AB][0-9A-F][89AB][0-9A-F]"
    "|F48[0-9A-F][89AB][0-9A-F][89AB][0-9A-F])|[0-9A-F]{2}"
)


def _expand_sql(source: str) -> str:
    """Steps from (request_id, text) to the text with decoded runs appended."""
    return f"""
      SELECT request_id, text || CASE WHEN len(parts) > 0 THEN ' ' || array_to_string(parts, ' ') ELSE '' END AS text
      FROM (SELECT request_id, text, list_filter(list_transform(runs, lambda r:
          decode(unhex(array_to_string(regexp_extract_all(hex(try(from_base64(
            CASE length(rtrim(r, '=')) % 4
              WHEN 0 THEN rtrim(r, '=')
              WHEN 2 THEN CASE WHEN length(r) - length(rtrim(r, '=')) = 2 THEN r ELSE '?' END
              WHEN 3 THEN CASE WHEN length(r) > length(rtrim(r, '=')) THEN rtrim(r, '=') || '=' ELSE '?' END
              ELSE '?' END))), '{_UTF8}', 1), '')))), lambda d: length(d) > {cfg.BASE64_MIN_DECODED}) AS parts
        FROM (SELECT *, regexp_extract_all(text, '[A-Za-z0-9+/]{{{cfg.BASE64_MIN_RUN},}}={{0,2}}') AS runs
              FROM ({source})))"""


_FIRST = " ".join(
    f"WHEN regexp_matches(low, {quote('(?i)' + p)}) THEN {quote(p)}" for p in cfg.INJECTION_PATTERNS
)
CTES["fx_scanned"] = f"""
    SELECT request_id, lower(text) AS low FROM ({_expand_sql(
        f"SELECT request_id, {_GLYPHS} AS text FROM fx_injection")})"""
CTES["fx_flagged"] = f"SELECT request_id, CASE {_FIRST} END AS pattern FROM fx_scanned"
CTES["fx_security_events"] = f"""
    SELECT ('0x' || substr(sha256(i.request_id || ':injection_blocked'), 1, 15))::BIGINT AS id, i.timestamp,
      'injection_blocked' AS event_type, f.pattern AS pattern_matched,
      CASE WHEN length(i.text) > 100 THEN left(i.text, 100) || '...' ELSE i.text END AS prompt_preview, i.source_ip
    FROM (SELECT * EXCLUDE (text), {redact_sql("text")} AS text FROM fx_injection) i JOIN fx_flagged f ON f.request_id = i.request_id WHERE f.pattern IS NOT NULL"""

_HEADER = """
    SELECT event_id AS request_id, CASE event_id % 7 WHEN 0 THEN 'key-' || (user_id % 5) WHEN 1 THEN '' WHEN 2 THEN NULL
      ELSE 'Bearer key-' || (user_id % 5) END AS header FROM events"""
_ALLOWED = [k.strip() for k in fx.ALLOWED_KEYS.split(",") if k.strip()]

SQL = {
    **{
        f"pii_{kind.lower()}": f"SELECT doc_id, {_sub('text', kind)} AS text FROM fx_pii"
        for kind in cfg.PII_PATTERNS
    },
    "pii_redact": f"SELECT doc_id, {redact_sql('text')} AS text FROM fx_pii",
    "pii_redact_conversation": f"""
        SELECT request_id, pos, CASE coalesce(json_type(content), 'NULL') WHEN 'NULL' THEN ''
            WHEN 'VARCHAR' THEN {redact_sql("(content->>'$')")}
            ELSE concat_ws(' ', CASE WHEN (content->>'$[0].type') = 'text' THEN {redact_sql("(content->>'$[0].text')")} END,
              CASE WHEN (content->>'$[1].type') = 'text' THEN {redact_sql("(content->>'$[1].text')")} END) END AS text
        FROM fx_messages""",
    "pii_type_counts": " UNION ALL ".join(
        f"SELECT '{kind}' AS pii_type, coalesce(sum({_count_sql(kind)}), 0)::BIGINT AS matches, "
        f"count(*) FILTER ({_count_sql(kind)} > 0)::BIGINT AS texts "
        f"FROM (SELECT {_sub('text', kind)} AS s FROM fx_pii)"
        for kind in cfg.PII_PATTERNS
    ),
    "entity_redact": _ENTITIES,
    "homoglyph_normalize": f"SELECT request_id, {_GLYPHS} AS text FROM fx_injection",
    "base64_expand": _expand_sql("SELECT request_id, text FROM fx_injection"),
    "injection_detect": "SELECT request_id, pattern IS NOT NULL AS is_injection, pattern FROM fx_flagged",
    "injection_split": """
        SELECT request_id, CASE WHEN pattern IS NULL THEN 'clean' ELSE 'blocked' END AS outcome FROM fx_flagged""",
    "blocked_injection_count": "SELECT count(*)::BIGINT AS blocked_injections FROM fx_security_events",
    "api_key_filter": f"""
        SELECT request_id, token, CASE WHEN token IS NULL THEN 'missing key'
          WHEN token IN (SELECT unnest({text_list(_ALLOWED)})) THEN 'accepted' ELSE 'invalid key' END AS outcome
        FROM (SELECT request_id, CASE WHEN coalesce(header, '') <> '' THEN regexp_replace(header, '^Bearer ', '') END AS token
              FROM ({_HEADER}))""",
    "api_key_preview": f"""
        SELECT request_id, left(regexp_replace(header, '^Bearer ', ''), {cfg.KEY_PREVIEW_CHARS}) || '...' AS preview
        FROM ({_HEADER})""",
}
SQL = {key: with_ctes(text) for key, text in SQL.items()}
