"""SimHash near-duplicates: fingerprints, links at a small Hamming distance, components.

A fingerprint is embedded as the bit counts of its 32 two-bit segments.  The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so it is a lower bound to search by: with the segments dealt into
g groups, two embeddings within distance d agree on at least g - d groups.  Each
choice of g - d groups is one grid, the bit counts of the chosen groups are the
cell; rows that share a cell are compared, first by the bound and then exactly.
No link is lost, whatever g is; g only sets how full the cells are.

Rows: a null text, or one without words, has fingerprint zero.  Copies share a
fingerprint and are one row from there on.  A null ``doc_id`` takes part, but is
never a component's id unless the component has no other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import lower_words, map_rows, written

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
CELL_ROWS = 4096  # a fuller cell is compared in blocks of this many rows
SMALL_CELL = 8  # up to here all pairs of a cell are tried side by side
PER_CELL = 4  # rows a cell should have on average, at most
_PAIRS = 0x5555555555555555
_SHINGLES_PER_STEP = 1 << 16


def fingerprint(words: list[bytes], size: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit fingerprint of a word sequence."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _SHINGLES_PER_STEP):
        spans = zip(first[at : at + _SHINGLES_PER_STEP], last[at : at + _SHINGLES_PER_STEP], strict=True)
        hashes = b"".join([digest(text[a:b], SEED) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every document; ``fp`` is a signed long."""

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [fingerprint(lower_words(t), size) for t in batch.column(1).to_pylist()]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def _grids(groups: int, distance: int) -> list[int]:
    """Bit masks, one for each choice of groups that have to agree."""
    segments = [[s for s in range(32) if s % groups == g] for g in range(groups)]
    masks = [sum(3 << (2 * s) for s in own) for own in segments]
    return [sum(c) for c in itertools.combinations(masks, groups - distance)]


def groups_for(rows: int, distance: int) -> int:
    """Groups with which cells hold few rows; a segment's bit count carries 1.5 bits."""
    groups = distance + 2
    while groups < 12 and rows > PER_CELL * 2 ** (48 * (groups - distance) / groups):
        groups += 1
    return groups


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, two bits each."""
    x = fps.view(np.uint64)
    return (x & np.uint64(_PAIRS)) + ((x >> np.uint64(1)) & np.uint64(_PAIRS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the segments' differences: a count of 0 against 2 differs in both bits of its Gray code."""
    return np.bitwise_count(_gray(a) ^ _gray(b))


def _gray(e: np.ndarray) -> np.ndarray:
    return e ^ ((e >> np.uint64(1)) & np.uint64(_PAIRS))  # 0 -> 00, 1 -> 01, 2 -> 11


def links(fps: DataFrame, distance: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``distance`` of each other.

    ``fps`` holds distinct fingerprints.  A cell yields a spanning forest of its
    links, not all of them.  A cell beyond ``cell_rows`` is cut into blocks, and
    each pair of blocks is compared by itself.
    """
    masks = np.array(_grids(groups_for(fps.count(), distance), distance), np.uint64)

    def cells(batch: pa.RecordBatch) -> list:
        own = batch.column(0).to_numpy()
        keys = (embed(own)[None, :] & masks[:, None]).view(np.int64)
        grid = np.repeat(np.arange(len(masks), dtype=np.int32), len(own))
        return [grid, keys.ravel(), np.tile(own, len(masks))]

    rows = map_rows(fps.select("fp"), cells, "grid int, cell long, fp long")
    full = rows.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    full = written(full.select("grid", "cell", F.ceil(F.col("n") / cell_rows).alias("blocks")), "full-cells")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (
        rows.join(full, ["grid", "cell"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        .withColumn("block", block)
        .withColumn("other", other)
        .select(
            "grid",
            "cell",
            (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("pair"),
            "fp",
        )
    )
    key = ["grid", "cell", "pair"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows == 0:
                continue
            parts = held if batch is None else [*held, batch]
            if not parts:
                continue
            rows = pa.Table.from_batches(parts)
            k = [rows.column(i).to_numpy() for i in range(3)]
            own = rows.column(3).to_numpy()
            new = np.ones(len(own), bool)
            new[1:] = (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])
            starts = np.append(np.nonzero(new)[0], len(own))
            if batch is None:
                held = []
            else:  # the last cell may go on in the next batch
                held = rows.slice(int(starts[-2])).to_batches()
                starts = starts[:-1]
            if len(starts) > 1:
                a, b = _linked(own, starts, distance)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _linked(fps: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what lies within ``distance`` in each run [starts[i], starts[i + 1])."""
    sizes = np.diff(starts)
    x, e = fps.view(np.uint64), embed(fps)
    found_a, found_b = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        near = manhattan(e[i], e[j]) <= distance
        i, j = i[near], j[near]
        near = np.bitwise_count(x[i] ^ x[j]) <= distance
        found_a.append(fps[i[near]])
        found_b.append(fps[j[near]])

    small = (sizes > 1) & (sizes <= SMALL_CELL)
    first, size = starts[:-1][small], sizes[small]
    for s in range(1, SMALL_CELL):
        for at in range(SMALL_CELL - s):
            i = first[at + s < size] + at
            keep(i, i + s)
    for start, stop in zip(starts[:-1][sizes > SMALL_CELL], starts[1:][sizes > SMALL_CELL], strict=True):
        rest = np.arange(start, stop)
        while len(rest):  # a search through what is not yet reached
            reach, rest = [rest[0]], rest[1:]
            while reach and len(rest):
                i = reach.pop()
                bound = manhattan(e[rest], e[i]) <= distance
                hit = bound & (np.bitwise_count(x[rest] ^ x[i]) <= distance)
                found_a.append(np.full(int(hit.sum()), fps[i]))
                found_b.append(fps[rest[hit]])
                reach.extend(rest[hit])
                rest = rest[~hit]
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return np.minimum(a, b), np.maximum(a, b)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link.

    Alternating large and small stars over written tables; every step moves links
    towards smaller nodes, and it ends when a round changes nothing.
    """
    edges = written(edges.select("a", "b").filter("a <> b"), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = written(_star(both, F.col("b") > F.col("a")), "large-star")
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = written(_star(down, F.lit(True), with_self=True), "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return own.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _star(edges: DataFrame, emitted, with_self: bool = False) -> DataFrame:
    """Each row's b linked to the least of a and a's neighbours, where ``emitted`` holds."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    rows = edges.filter(emitted).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if with_self:
        rows = rows.unionAll(least.select("a", F.col("m").alias("b")))
    return rows.filter("a <> b").distinct()


def _rooted(nodes: DataFrame, distance: int, cell_rows: int) -> DataFrame:
    """(fp, least, root): ``nodes`` (fp, least) with the least fingerprint of their component."""
    roots = components(links(nodes, distance, cell_rows))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    return written(rooted, "rooted")


def simhash_components(
    docs: DataFrame, distance: int = MAX_DISTANCE, size: int = SHINGLE_WORDS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(doc_id, fp, component_id), one row per document.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``distance`` differing bits, the document itself included.
    """
    own = written(fingerprints(docs, size), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    rooted = _rooted(nodes, distance, cell_rows)
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(tops, "root").select("fp", "component_id"), "components")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates_removed(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents with one row of each component: that with the smallest doc_id.

    Rows without a doc_id come last, and hashes decide between rows with one doc_id,
    so that the same row stays in every run.  Only rows alike in all columns collapse
    by their key; other rows with one doc_id are documents of their own.
    """
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    version = F.concat(F.coalesce(F.md5("text"), F.lit("")), F.lit("-"), F.md5(rest))
    keyed = docs.withColumn("__version", version)

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), batch.column(1), [fingerprint(lower_words(t)) for t in batch.column(2).to_pylist()]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = map_rows(keyed.select("doc_id", "__version", "text"), run, f"doc_id {kind}, version string, fp long")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")
    nodes = written(own.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-nodes")
    tops = _rooted(nodes, distance, CELL_ROWS).groupBy("root").agg(F.min("least").alias("least"))
    keep = written(tops.select(F.col("least.doc_id").alias("__id"), F.col("least.version").alias("__of")), "kept-keys")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__version") == F.col("__of"))
    return keyed.join(keep, same, "left_semi").dropDuplicates(["doc_id", "__version"]).drop("__version")
