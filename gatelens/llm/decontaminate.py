"""Which words of a document lie inside benchmark passages, by a prefix-filtered set join.

An item gives its windows of 13 consecutive words, an item of fewer words one
window of its own size.  A window is a set of positioned shingles that must all
occur, so one necessary shingle is its whole prefix: the rarest one, by counts
over the corpus.  A document joins with the windows of those prefix shingles it
holds.  The shingle's place in the window fixes where the window would start
(positional bound) and that it must end within the document (length bound); then
all words are compared.

The windows of a benchmark are cut into blocks of at most ``block_bytes``, which
bounds what is broadcast; documents are read once per block for the counts and
once for the join, and are never shuffled.

Rows: a null or empty text has no words and no hits.  Items without words match
nothing; a null ``item_id`` gives hits but is not listed.  Repeated items, windows
and rows count once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import alnum_words, map_rows, with_struct, written

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
BLOCK_BYTES = 16 << 20  # fewer than 2 million words, so three of them make a 64-bit code
_FOUND = "__found"
_ROW_BYTES = 64


def item_windows(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(words, item_ids): distinct windows, space-joined, with the items that hold them."""

    def run(batch: pa.RecordBatch) -> list:
        ids, windows = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = alnum_words(text)
            for at in range(max(1, len(words) - window + 1) if words else 0):
                ids.append(item)
                windows.append(b" ".join(words[at : at + window]).decode("utf-8", "surrogatepass"))
        return [ids, windows]

    rows = map_rows(items.select(F.col("item_id").cast("string"), "text"), run, "item_id string, words string")
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))


class _Index:
    """Windows of one block as word numbers, and their shingles as sorted codes per size."""

    def __init__(self, rows: list, size: int):
        texts = [r.words.encode("utf-8", "surrogatepass").split(b" ") for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.windows = [[number(w, len(self.vocabulary) + 1) for w in t] for t in texts]
        self.items = [tuple(r.item_ids) for r in rows]
        self.base = len(self.vocabulary) + 1
        self.size = size
        sizes = {min(size, len(w)) for w in self.windows}
        self.codes = {
            n: np.unique([c for w in self.windows if min(size, len(w)) == n for c in self.shingles(np.array(w), n)])
            for n in sizes
        }
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def shingles(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """A code per position; zero where a word is in no window."""
        n = len(numbers) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = numbers[:n].copy(), numbers[:n] > 0
        for k in range(1, size):
            code = code * self.base + numbers[k : k + n]
            known &= numbers[k : k + n] > 0
        return np.where(known, code, 0)

    def count(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(size, code, times) of the block's shingles in a text."""
        for n, codes in self.codes.items():
            own = self.shingles(numbers, n)
            own = own[own > 0]
            if len(own):
                at = np.searchsorted(codes, own).clip(max=len(codes) - 1)
                code, times = np.unique(own[codes[at] == own], return_counts=True)
                yield from zip(repeat(n), code.tolist(), times.tolist())

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """The rarest shingle of each window becomes its prefix."""
        for w, numbers in enumerate(self.windows):
            n = min(self.size, len(numbers))
            codes = self.shingles(np.array(numbers), n).tolist()
            at = min(range(len(codes)), key=lambda i: (counts.get((n, codes[i]), 0), i))
            self.prefixes.setdefault(n, {}).setdefault(codes[at], []).append((at, w))
        self.codes = {n: np.array(sorted(p), np.int64) for n, p in self.prefixes.items()}

    def hits(self, numbers: np.ndarray) -> tuple[set[tuple[int, int]], set[str]]:
        """Spans of the windows that occur, and their items."""
        spans, items, plain = set(), set(), None
        for n, codes in self.codes.items():
            own = self.shingles(numbers, n)
            if not len(own):
                continue
            at = np.searchsorted(codes, own).clip(max=len(codes) - 1)
            for place in np.nonzero(codes[at] == own)[0].tolist():
                plain = plain or numbers.tolist()
                for offset, w in self.prefixes[n][int(own[place])]:
                    start, window = place - offset, self.windows[w]
                    if start >= 0 and plain[start : start + len(window)] == window:
                        spans.add((start, start + len(window)))
                        items.update(i for i in self.items[w] if i is not None)
        return spans, items


def _blocks(items: DataFrame, window: int, size: int, block_bytes: int) -> Iterator[_Index]:
    windows = written(item_windows(items, window), "windows")
    weight = F.octet_length("words") + F.coalesce(
        F.aggregate("item_ids", F.lit(0), lambda n, i: n + F.octet_length(i) + 8), F.lit(0)
    )
    total = windows.agg(F.sum(weight + _ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()
        yield _Index(rows, size)


def _counted(docs: DataFrame, index) -> dict[tuple[int, int], int]:
    """How often the corpus holds each shingle of a block."""
    schema = "size int, code long, times long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = index.value, {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for n, code, times in own.count(own.numbers(alnum_words(text))):
                    seen[n, code] = seen.get((n, code), 0) + times
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k, _ in rows], pa.int32()),
                pa.array([k[1] for k, _ in rows], pa.int64()),
                pa.array([n for _, n in rows], pa.int64()),
            ],
            ["size", "code", "times"],
        )

    counted = docs.select("text").mapInArrow(count, schema).groupBy("size", "code").agg(F.sum("times").alias("n"))
    return {(r["size"], r.code): r.n for r in counted.collect()}


def overlap(
    docs: DataFrame,
    items: DataFrame,
    result: str = "overlap",
    window: int = WINDOW_WORDS,
    size: int = SHINGLE_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All documents with a struct ``result``: n_words, n_hit and the sorted ids of items found."""
    context, found, again = docs.sparkSession.sparkContext, docs, False
    for index in _blocks(items, window, size, block_bytes):
        if again:  # one block at a time is in a task's memory
            found = written(found, "overlap")
        if index.windows:
            index.choose(_counted(docs, context.broadcast(index)))
        found, again = _joined(found, context.broadcast(index), again), True
    names = F.array_sort(F.array_distinct(f"{_FOUND}.items"))
    whole = F.struct(f"{_FOUND}.n_words", f"{_FOUND}.n_hit", names.alias("items"))
    return found.withColumn(result, whole).drop(_FOUND)


def _joined(docs: DataFrame, index, again: bool) -> DataFrame:
    """Documents with what one block adds to what earlier blocks have found."""
    earlier = "__earlier"

    def run(batch: pa.RecordBatch) -> list:
        own, out = index.value, [[] for _ in range(5)]
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        before = batch.column(batch.schema.get_field_index(earlier)).to_pylist() if again else repeat(None, len(texts))
        for text, old in zip(texts, before, strict=True):
            numbers = own.numbers(alnum_words(text))
            spans, names = own.hits(numbers)
            if old:
                spans.update(zip(old["starts"], old["stops"], strict=True))
                names.update(old["items"])
            inside = np.zeros(len(numbers), bool)
            for start, stop in spans:
                inside[start:stop] = True
            row = (len(numbers), int(inside.sum()), list(names), [a for a, _ in spans], [b for _, b in spans])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    docs = docs.withColumnRenamed(_FOUND, earlier) if again else docs
    fields = "n_words long, n_hit long, items array<string>, starts array<long>, stops array<long>"
    return with_struct(docs, _FOUND, fields, run).drop(earlier)


def contaminated(n_hit, n_words):
    """A twentieth of the words, and at least one, lie in benchmark passages."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
