"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

Documents are dealt into blocks.  A block's distinct n-grams, with counts, go to
buckets by hash: one row per block and bucket, the hashes as an array.  A bucket
adds up the counts of its n-grams over all blocks, which is its part of the count
table, and joins them back to the n-grams of each block as an array in the same
order.  A block then scores its documents.  An n-gram has one entry per block
however often it occurs, so frequent ones make no large group; arrays keep what
is shuffled near eight bytes per distinct n-gram and block.

The score of a word is count(n-gram) / count(context) for the longest n-gram seen
in another document, times ``ALPHA`` for each shorter step; a word seen nowhere
else counts as one in all the words.  Counts leave out the document itself.

Rows: a null text has no words, a sum of 0 and a null mean.  Repeated rows are
documents of their own.  Hashes have 64 bits; equal hashes count as equal n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import alnum_words, map_rows

ALPHA = 0.4
ORDER = 2
BLOCK_BYTES = 8 << 20  # of text
BUCKET_GRAMS = 2_000_000  # entries of a bucket, about
PER_TASK = 2  # blocks or buckets that a task gets, on average
_EMPTY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: list[bytes], order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, for n = 1 to ``order``; n-gram i of n starts at word i."""
    digest = xxhash.xxh64_digest
    one = np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)
    grams = [_mixed(one ^ _EMPTY)]
    for n in range(2, order + 1):
        grams.append(_mixed(grams[-1][:-1] * np.uint64(31) + one[n - 1 :]) if len(one) >= n else one[:0])
    return grams


def _block_grams(texts: list[str | None], order: int) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray]:
    """Hashes per document, and the distinct ones of the block with their counts."""
    own = [gram_hashes(alnum_words(t), order) for t in texts]
    every = np.concatenate([g for grams in own for g in grams] or [np.empty(0, np.uint64)])
    distinct, counts = np.unique(every, return_counts=True)
    return own, distinct, counts


def _bucket_parts(distinct: np.ndarray, buckets: int) -> tuple[list[int], list[slice]]:
    """The buckets of sorted hashes, which are equal ranges, and what falls into each."""
    number = (distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    own, first = np.unique(number, return_index=True)
    ends = np.append(first[1:], len(distinct))[: len(own)]
    return own.tolist(), [slice(i, j) for i, j in zip(first, ends, strict=True)]


def _requests(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    schema = "bucket int, block long, grams binary, counts binary"

    def run(table: pa.Table) -> pa.Table:
        _, distinct, counts = _block_grams(table.column("text").to_pylist(), order)
        full, parts = _bucket_parts(distinct, buckets)
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()] * len(full), pa.int64()),
                "grams": pa.array([distinct[p].tobytes() for p in parts], pa.binary()),
                "counts": pa.array([counts[p].astype(np.uint32).tobytes() for p in parts], pa.binary()),
            }
        )

    return docs.groupBy("block").applyInArrow(run, schema)


def _totals(requests: DataFrame) -> DataFrame:
    """(block, bucket, totals): for the n-grams of each request, their counts over all blocks."""
    schema = "block long, bucket int, totals binary"

    def run(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(place, counts, len(distinct)).astype(np.uint64)[place]
        ends = np.cumsum([len(g) for g in grams])
        parts = np.split(totals, ends[:-1])
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "totals": pa.array([p.tobytes() for p in parts], pa.binary()),
            }
        )

    return requests.groupBy("bucket").applyInArrow(run, schema)


def document_score(grams: list[np.ndarray], distinct: np.ndarray, totals: np.ndarray, all_words: int, alpha: float) -> float:
    """Sum over the words of the log10 of their scores."""
    n_words = len(grams[0])
    if not n_words:
        return 0.0
    others = []
    for own in grams:  # counts in other documents
        mine, place, times = np.unique(own, return_inverse=True, return_counts=True)
        others.append((totals[np.searchsorted(distinct, mine)].astype(np.int64) - times)[place])
    rest = max(1, all_words - n_words)
    score = np.log10(np.maximum(others[0], 1) / rest)
    for n in range(2, len(grams) + 1):
        if n_words < n:
            break
        seen, context = others[n - 1], others[n - 2][: n_words - n + 1]
        longer = np.log10(np.maximum(seen, 1) / np.maximum(context, 1))
        score[n - 1 :] = np.where(seen > 0, longer, np.log10(alpha) + score[n - 1 :])
    return float(score.sum())


def backoff_scores(
    docs: DataFrame,
    order: int = ORDER,
    alpha: float = ALPHA,
    block_bytes: int = BLOCK_BYTES,
    bucket_grams: int = BUCKET_GRAMS,
) -> DataFrame:
    """(doc_id, n_words, score_sum, score_mean) with base-10 logarithms, one row per document."""

    def size(batch: pa.RecordBatch) -> list:
        texts = batch.column(0).to_pylist()
        return [[sum(len(alnum_words(t)) for t in texts)], [sum(len(t or "") for t in texts)]]

    sizes = map_rows(docs.select("text"), size, "words long, chars long")
    all_words, chars = (n or 0 for n in sizes.agg(F.sum("words"), F.sum("chars")).first())
    blocks = max(1, -(-chars // block_bytes))
    buckets = max(1, -(-all_words * order // bucket_grams))
    # By place in the input, so that no id or text can fill a block.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    # As many tasks as the data need, so that what one holds does not grow with the input.
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda n: max(least, -(-n // PER_TASK))
    dealt = docs.select("doc_id", "text", block.alias("block")).repartition(tasks(blocks), "block")
    answers = _totals(_requests(dealt, order, buckets).repartition(tasks(buckets), "bucket"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, score_sum double, score_mean double"

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        grams, distinct, _ = _block_grams(own.column("text").to_pylist(), order)
        parts = found.sort_by("bucket").column("totals").to_pylist()
        totals = np.concatenate([np.frombuffer(p, np.uint64) for p in parts] or [np.empty(0, np.uint64)])
        sums = [document_score(g, distinct, totals, all_words, alpha) for g in grams]
        n_words = [len(g[0]) for g in grams]
        return pa.table(
            {
                "doc_id": own.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "score_sum": pa.array(sums, pa.float64()),
                "score_mean": pa.array([s / n if n else None for s, n in zip(sums, n_words, strict=True)], pa.float64()),
            }
        )

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
