"""Prompt normalisation and cache keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens import settings as cfg


def normalize_prompt(text: Column) -> Column:
    """Lower-case, white space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def tenant_salt(api_key: Column) -> Column:
    """First 16 hex digits of the key's SHA-256; ``global`` without a key."""
    return F.when(
        F.coalesce(api_key, F.lit("")) != "", F.substring(F.sha2(api_key, 256), 1, 16)
    ).otherwise("global")


def prompt_hash(salt: Column, normalized: Column) -> Column:
    return F.sha2(F.concat(salt, F.lit(":"), normalized), 256)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def has_words(text: Column, n: int) -> Column:
    """At least ``n`` words, without looking at what follows them."""
    return F.rlike(text, F.lit(r"(?U)^\s*+(?:\S++\s++){%d}\S" % (n - 1)))


def preview(text: Column, chars: int) -> Column:
    """The text itself, or its first ``chars`` characters and an ellipsis."""
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def token_count_est(text: Column) -> Column:
    """Number of pre-tokens: a lower bound of the byte-pair token count."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(cfg.PRETOKEN_PATTERN)).cast("long")


def token_count(text: Column, ranks: str | None = None) -> Column:
    """Byte-pair token count with a supplied rank file, else the estimate.

    ``ranks`` is the path of a public cl100k rank file that every executor can
    read.  Each Python worker loads it once; text arrives in Arrow batches.
    """
    if ranks is None:
        return token_count_est(text)

    @F.pandas_udf("long")
    def counted(batch: pd.Series) -> pd.Series:
        encoding = _encoding(ranks)
        encoded = encoding.encode_ordinary_batch(batch.fillna("").tolist(), num_threads=1)
        return pd.Series([len(tokens) for tokens in encoded])

    return counted(text)


_ENCODINGS: dict = {}


def _encoding(ranks: str):
    if ranks not in _ENCODINGS:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        # Fixed value: the public cl100k pre-token pattern.
        pattern = (
            r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+"
            r"| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
        )
        _ENCODINGS[ranks] = tiktoken.Encoding(
            name="cl100k_from_file",
            pat_str=pattern,
            mergeable_ranks=load_tiktoken_bpe(ranks),
            special_tokens={},
        )
    return _ENCODINGS[ranks]
