"""Queries of this package, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import (
    anchors,
    backoff,
    chat,
    decontaminate,
    hyperminhash,
    infill,
    ordinal,
    packing,
    quality_rules,
    secret_scan,
    simhash,
    substrings,
    toxicity,
)
from gatelens.llm.common import documents, written


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_copies(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        "text",
        F.size("copies.starts").alias("n_passages"),
        F.col("copies.removed").alias("removed_chars"),
        F.col("copies.first_docs").alias("first_docs"),
    )


def packed_pieces(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = packing.tokenize(docs, ranks, public_tokenizers.PATTERN, added=added)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_words, n_hit = F.col("overlap.n_words"), F.col("overlap.n_hit")
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "overlap.items"), 256).alias("items_sha256"),
        decontaminate.contaminated(n_hit, n_words).alias("contaminated"),
    )


OP3_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_starts AS (
    SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p
    FROM item_words WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS words FROM item_starts
), starts AS (
    SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p
    FROM words, (SELECT DISTINCT size FROM windows)
    WHERE len(w) >= size
), hits AS (
    SELECT s.doc_id, s.p, s.size, v.item_id
    FROM (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS words FROM starts) s
    JOIN windows v ON v.size = s.size AND v.words = s.words
), covered AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM (SELECT DISTINCT doc_id, p, size FROM hits))
    GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits)
    GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir))


_RULES = list(quality_rules.SLACK.items())
_LIMIT = f"high + {quality_rules.REACH} * (high - low) + slack"
OP4_SQL = rf"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT row, p, array_to_string(w[p:p + 2], ' ') AS gram
    FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM words)
), twice AS (
    SELECT row, unnest(positions) AS p
    FROM (SELECT row, list(p) AS positions FROM grams GROUP BY row, gram HAVING count(*) > 1)
), repeats AS (
    SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest([p, p + 1, p + 2]) AS pos FROM twice) GROUP BY row
), lines AS (
    SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS doubles
    FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), counts AS (
    SELECT row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(doubles, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
           coalesce(l.n, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
           length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS n_marks
    FROM words LEFT JOIN repeats r USING (row) LEFT JOIN lines l USING (row)
), rates AS (
    SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed,
           1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
           1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_capitals // greatest(word_chars, 1) AS capitals,
           1000 * n_marks // greatest(word_chars, 1) AS marks, 100 * word_chars // greatest(n_words, 1) AS word_length
    FROM counts
), long AS (
    {" UNION ALL ".join(f"SELECT row, lang, source, base_failed, '{r}' AS rule, {s} AS slack, {r} AS rate FROM rates" for r, s in _RULES)}
), truncated AS (
    SELECT *, CAST(1 AS BIGINT) << greatest(length(bin(CAST(rate AS BIGINT))) - 7, 0) AS width,
           CAST(rate AS BIGINT) - CAST(rate AS BIGINT) % width AS bucket
    FROM long WHERE NOT base_failed
), sets AS (
    SELECT 1 AS level, lang, source, rule, slack, bucket, width FROM truncated UNION ALL
    SELECT 2, lang, NULL, rule, slack, bucket, width FROM truncated UNION ALL
    SELECT 3, NULL, NULL, rule, slack, bucket, width FROM truncated
), quartiles AS (
    SELECT level, lang, source, rule, any_value(slack) AS slack, count(*) AS n,
           quantile_disc(bucket, 0.25) AS low, quantile_disc(bucket + width - 1, 0.75) AS high
    FROM sets GROUP BY level, lang, source, rule
), limits AS (
    SELECT g.lang, g.source, g.rule, CASE WHEN g.n >= {quality_rules.LEAST} THEN g.most WHEN l.n >= {quality_rules.LEAST} THEN l.most ELSE e.most END AS most
    FROM (SELECT *, {_LIMIT} AS most FROM quartiles WHERE level = 1) g
    JOIN (SELECT *, {_LIMIT} AS most FROM quartiles WHERE level = 2) l ON l.rule = g.rule AND l.lang IS NOT DISTINCT FROM g.lang
    JOIN (SELECT *, {_LIMIT} AS most FROM quartiles WHERE level = 3) e ON e.rule = g.rule
), verdicts AS (
    SELECT x.row, bool_and(x.rate <= t.most) AS within
    FROM long x LEFT JOIN limits t ON t.rule = x.rule AND t.lang IS NOT DISTINCT FROM x.lang AND t.source IS NOT DISTINCT FROM x.source
    GROUP BY x.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept
FROM rates JOIN verdicts USING (row)
"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = chat.repaired_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repaired.select(
        "conv_id", "turn", "role", "new_role", "action", "n_inserted", "rendered", "is_last", "cost"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("toxicity.score")
    return toxicity.scored(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.fold("doc_id") == 1, F.lit(False)).alias("held_out"),
        score.alias("score"),
        F.when(score >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.col("toxicity.n_hits").alias("n_hits"),
        F.col("toxicity.n_quoted").alias("n_quoted"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(documents(spark, sf_dir).select("doc_id", "text"))
    zipped = F.arrays_zip("secrets.kinds", "secrets.starts", "secrets.ends")
    named = F.transform(zipped, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))
    base = F.filter(named, lambda s: F.split_part(s, F.lit(":"), F.lit(1)).isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets.kinds", lambda k: k == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", named).alias("spans"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = ordinal.fit(docs, ordinal.label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    tail = lambda k: F.coalesce(F.try_element_at("quality.tails", F.lit(k)), F.lit(1.0))
    return ordinal.graded(docs, model).select(
        "doc_id",
        F.col("quality.grade").alias("expected_grade"),
        tail(1).alias("p_at_least_1"),
        tail(2).alias("p_at_least_2"),
        (tail(1) >= ordinal.KEEP).alias("kept"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(documents(spark, sf_dir).select("doc_id", "text"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = infill.infilled(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "infill.*")
    return infill.restored(parts).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored.text", 256).alias("restored_sha256"),
    )


OP11_SQL = rf"""
WITH tokens AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{infill.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS t
    FROM documents
), draws AS (
    SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM tokens
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {infill.PERCENT} THEN 'plain'
                WHEN h4 % 100 < {infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
    FROM draws
), parts AS (
    SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle,
           array_to_string(t[b + 1:], '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = anchors.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    rows = written(found.select("vec_id", "label", "pq.code", "pq.error"), "vector-codes")
    totals = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(anchors.books_sha256(books)).alias("codebooks_sha256")
    )

def op13_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_components(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_simhash_components": op10_simhash_components,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_minhash_components": op13_minhash_components,
}
SQL: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
