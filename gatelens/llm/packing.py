"""Best-fit-decreasing packing of tokenized documents into windows of fixed size.

Overlong documents are first cut into full windows.  Then best-fit decreasing
depends on nothing but how many pieces have each length, at most one count per
token of the window, whatever the corpus holds.  The driver packs that histogram:
a segment tree over remaining capacities gives the tightest open windows for a
length, and one step fills all windows of a kind alike.  Each piece then finds
its place from its rank among the pieces of its length.  Ranks come from numbers
within each partition and sums over partitions, so no length is gathered in one
task.

Rows: a null text counts as empty and is the end token alone.  Repeated rows and
ids are packed one by one.  Other columns of the input are not carried.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from gatelens.llm.common import map_rows, written

WINDOW = 2048
END_ID = 1
CACHED_CHUNKS = 400_000  # of a task; then the memory starts anew
CACHED_CHARS = 48  # longer chunks are not remembered
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # White_Space
# The pre-tokenizer never joins what these chunks keep apart.
_CHUNK = f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_RANKS = 1 << 44  # more pieces of one length than any corpus has


class _Ids(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u4").tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


def added_tokens(json_path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON file and their ids; they are found in a text before all else."""
    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that are not plain strings: {odd}")
    return {t["content"]: t["id"] for t in added}


def tokenize(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): documents with an end token, cut into pieces of up to ``window`` ids.

    ``ids`` holds little-endian unsigned 32-bit numbers.  ``ranks_path`` is a byte
    BPE rank file that every executor can open, ``pattern`` its pre-tokenizer's.
    ``added`` tokens cut a text; without them their strings are ordinary text.
    """
    own = {content: np.array([number], "<u4").tobytes() for content, number in (added or {}).items()}
    # The longest of those that start at one place.
    cut = re.compile(f"({'|'.join(map(re.escape, sorted(own, key=len, reverse=True)))})").split if own else lambda t: [t]
    end = np.array([end_id], "<u4").tobytes()
    find = re.compile(_CHUNK).findall
    kind = docs.schema["doc_id"].dataType.simpleString()
    state: dict[str, _Ids] = {}

    def run(batch: pa.RecordBatch) -> list:
        known = state.get("ids") or state.setdefault("ids", _Ids(ranks_path, pattern))
        rows, starts, lengths, totals, ids = [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            parts = cut(text or "")  # every second one is an added token
            data = b"".join(
                own[part] if at % 2 else b"".join(map(known.__getitem__, find(part))) for at, part in enumerate(parts)
            ) + end
            total = len(data) // 4
            for start in range(0, total, window):
                rows.append(row)
                starts.append(start)
                lengths.append(min(window, total - start))
                totals.append(total)
                ids.append(data[4 * start : 4 * (start + window)])
        return [batch.column(0).take(pa.array(rows, pa.int32())), starts, lengths, totals, ids]

    return map_rows(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    )


class Capacities:
    """A segment tree over remaining capacities: which have open windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.kinds: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
        self.filled = [0] * (2 * self.size)

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.filled[node] += by
            node //= 2

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.kinds[capacity].append((first, count))
            self._count(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.kinds[capacity].pop()

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` with an open window."""
        node = length + self.size
        if self.filled[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.filled[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Places for all pieces and the number of windows.

    A place (length, rank, per, sequence, offset) holds for pieces of ``length``
    from ``rank`` on: piece i lies in window ``sequence + (i - rank) // per`` at
    ``offset + (i - rank) % per * length``.  Pieces of one length fill a window
    until it can take no more of them, which is what best fit does one by one: a
    window that still has room is the tightest.
    """
    capacities, places, windows = Capacities(window), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = capacities.tightest(length)
            if capacity is None:
                capacity, first, count = window, windows, -(-left // (window // length))
                windows += count
            else:
                first, count = capacities.take(capacity)
            per = capacity // length
            put = min(left, count * per)
            full, rest = divmod(put, per)
            places.append((length, rank, per, first, window - capacity))
            capacities.add(capacity - per * length, first, full)
            if rest:
                capacities.add(capacity - rest * length, first + full, 1)
            used = full + bool(rest)
            capacities.add(capacity, first + used, count - used)
            rank, left = rank + put, left - put
    return np.array(places, np.int64).reshape(-1, 5), windows


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """All ``pieces`` with ``sequence_id`` and ``offset``; ``length`` counts at most ``window``."""
    pieces = written(_numbered(pieces), "pieces")
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        pieces.groupBy("length", "__part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    counts = written(counts, "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, _ = best_fit_decreasing(histogram, window)
    order = np.lexsort((table[:, 1], table[:, 0]))
    places = pieces.sparkSession.sparkContext.broadcast(table[order])
    ranked = pieces.join(counts.drop("n"), ["length", "__part"]).withColumn("__rank", F.col("__before") + F.col("__nth"))
    ranked = ranked.drop("__part", "__nth", "__before")
    schema = StructType(
        [f for f in ranked.schema if f.name != "__rank"]
        + [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    )
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, per, first, offset = places.value.T
        keys = lengths * _RANKS + ranks
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "__rank"))
            at = np.searchsorted(keys, length * _RANKS + rank, side="right") - 1
            window_of, slot = np.divmod(rank - ranks[at], per[at])
            own = [batch.column(n) for n in arrow.names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(first[at] + window_of), pa.array(offset[at] + slot * length)], schema=arrow
            )

    return ranked.mapInArrow(place, schema)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with their partition and their number among the pieces of their length there."""
    schema = StructType([*pieces.schema, StructField("__part", IntegerType()), StructField("__nth", LongType())])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            nth = []
            for length in batch.column("length").to_pylist():
                nth.append(seen.get(length, 0))
                seen[length] = nth[-1] + 1
            more = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=arrow)

    return pieces.mapInArrow(number, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids): the packed windows themselves, from pieces that carry ``ids``.

    A window is padded with ``pad_id`` to its full size, unless what it holds is a
    power of two long.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["ids"]))
    held = packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_ids"))
    size = F.when(F.bit_count("n_ids") == 1, F.col("n_ids")).otherwise(F.lit(window))
    pad = F.lit(np.array([pad_id], "<u4").tobytes())
    return held.select("sequence_id", "n_ids", F.rpad("ids", (4 * size).cast("int"), pad).alias("ids"))
