"""Quality rules whose thresholds follow each language and source.

Every rate of a document that passes the base rule (per mille, whole numbers) goes
into a quantile sketch per language and source: counts by the rate's seven leading
bits.  Such sketches merge by adding counts, so tasks summarize before the shuffle,
no order changes them, and one group may hold any share of the rows.  A rule's
threshold lies ``REACH`` quartile distances above the group's upper quartile, so
marks, capitals and word lengths have no cutoff of their own: what is usual in one
source is too much in another.  Repeats are absent from most documents, so their
quartiles are mostly nil; only these two rules have an allowance on top.  A group
of fewer than ``least`` such documents takes the merged sketch of its language, and
a language of fewer that of all documents.  Documents then join with the thresholds.

Rows: a null text has no words and fails the base rule.  Null languages and
sources are groups like any other.  Repeated rows count and are judged each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelens.llm.common import utf8, with_struct, written

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in windows found twice
LEAST = 30
REACH = 5  # quartile distances
#: Allowance of each rule, in its unit.
SLACK = {"dup_lines": 350, "repeats": 400, "capitals": 0, "marks": 0, "word_length": 0}
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(
    f"{rule} long" for rule in SLACK
)
_SPACE = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = np.unique(own[:-1] * len(known) + own[1:], return_inverse=True)[1]
    _, at, times = np.unique(pairs[:n] * len(known) + own[2:], return_inverse=True, return_counts=True)
    twice = np.nonzero(times[at] > 1)[0]
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[twice + k] = True
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """Counts of a text, and its rates in the order of the rules."""
    data = utf8(text)
    words = data.split()
    chars = len(text or "") - _count(data, _SPACE)
    lines = [line for line in data.split(b"\n") if line.strip()]
    symbols, repeated, doubles = _count(data, _SYMBOLS), repeated_words(words), len(lines) - len(set(lines))
    per_char, per_word, per_line = max(chars, 1), max(len(words), 1), max(len(lines), 1)
    return (
        len(words),
        chars,
        symbols,
        doubles,
        repeated,
        1000 * doubles // per_line,
        1000 * repeated // per_word,
        1000 * _count(data, _CAPITALS) // per_char,
        1000 * _count(data, _MARKS) // per_char,
        100 * chars // per_word,
    )


def measured(docs: DataFrame, result: str = "measures") -> DataFrame:
    """All documents with a struct ``result`` of counts and rates."""

    def run(batch: pa.RecordBatch) -> list:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return list(zip(*map(measure, texts), strict=True))

    return with_struct(docs, result, FIELDS, run)


def sketch(rates: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, bucket, n): how many rates have the same seven leading bits, set to the least such rate."""
    rows = rates.select(
        *by, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("rate")) for r in SLACK])).alias("r")
    ).select(*by, "r.rule", "r.rate")
    rows = rows.withColumn("rest", _rest("rate")).withColumn("bucket", F.expr("shiftleft(shiftright(rate, rest), rest)"))
    return rows.groupBy(*by, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _rest(rate: str) -> Column:
    """How many bits follow the seven leading ones."""
    return F.greatest(F.length(F.bin(rate)) - 7, F.lit(0))


def thresholds(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, one threshold per rule) from a sketch."""
    own = Window.partitionBy(*by, "rule")
    upto = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(own))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    limits = summed.groupBy(*by, "rule").agg(
        F.first("all").alias("n"), quartile(1).alias("low"), quartile(3).alias("high")
    )
    slack = F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair])[F.col("rule")]
    limits = limits.withColumn("rest", _rest("high"))
    high = F.expr("high + shiftleft(1L, rest) - 1")  # the last rate of its bucket
    limit = high + REACH * (high - F.col("low")) + slack
    pick = lambda rule: F.max(F.when(F.col("rule") == rule, limit)).alias(f"most_{rule}")
    return limits.groupBy(*by).agg(F.max("n").alias("n"), *map(pick, SLACK))


def group_thresholds(rates: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, thresholds) of every group, from the narrowest sketch of at least ``least`` documents."""
    counts = written(sketch(rates, ["lang", "source"]), "rate-sketch")
    add = lambda by: counts.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    names = [f"most_{rule}" for rule in SLACK]
    level = lambda df, by: df.select(*by, F.struct("n", *names).alias("own"))
    group = level(thresholds(counts, ["lang", "source"]), ["lang", "source"]).alias("g")
    lang = level(thresholds(add(["lang"]), ["lang"]), ["lang"]).alias("l")
    every = level(thresholds(add([]), []), []).alias("e")
    joined = group.join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")), "left").join(F.broadcast(every))
    chosen = F.when(F.col("g.own.n") >= least, F.col("g.own")).when(F.col("l.own.n") >= least, F.col("l.own"))
    return joined.select("g.lang", "g.source", chosen.otherwise(F.col("e.own")).alias("own")).select(
        "lang", "source", *[f"own.{n}" for n in names]
    )


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, the counts, base_failed, kept), one row per document."""
    slim = measured(docs.select("doc_id", "text", "lang", "source"))
    slim = written(slim.select("doc_id", "lang", "source", "measures.*"), "measures")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    limits = written(group_thresholds(slim.filter(~base), least), "thresholds").alias("t")
    m = slim.alias("m")
    same = F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source"))
    within = F.lit(True)
    for rule in SLACK:
        within = within & (F.col(f"m.{rule}") <= F.col(f"t.most_{rule}"))
    return m.join(limits, same, "left").select(
        "m.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & within).alias("kept"),
    )
