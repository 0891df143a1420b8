"""MinHash near-duplicates over compressed registers: components of documents with similar shingle sets.

A text's set is its distinct four-word shingles, as 64-bit hashes.  The sketch deals the
hashes into 256 buckets and keeps of each bucket's least hash only the count of leading
zeros and ten mantissa bits, in 16 bits.  Two sketches agree in a bucket if both have the
same least hash there, or by chance; the odds of chance follow from the set sizes and are
taken out of the estimate of the Jaccard similarity.

Documents with equal sets are one node.  A band is the first ``BAND`` occupied registers
along one of ``BANDS`` fixed orders of the buckets; nodes with an equal band are in one
cell.  Orders run over occupied registers, so bands are as telling for short texts as for
long ones, and a pair at the least similarity shares none of the cells with odds of about
10**-9.  Very short texts also get bands of two registers.

All pairs of a cell are never made.  In each of a few hub rounds, every one over its
share of the bands, a cell names one member its hub, and each node is compared with the
hub it shares most cells with, unless both are already in one component; a pair counts
if sizes and estimate allow it and the full sets confirm it.  Cells that then still hold
several components are compared register by register, in blocks and between components
only.  First each cell gives the most similar pairs that would span its components, and
these are confirmed, again and again until none is; what still holds apart then has all
its possible pairs confirmed.  Each time after the first, only nodes that were in a
possible pair the time before are compared again.  So big
groups of near copies are joined by few pairs, and no pair that shares a cell is left out.
Sets and sketches are written once, bucketed by node, and joins do not shuffle them.

An estimate stops a pair only if it lies more than ``SIGMAS`` standard deviations below
the least similarity, or if more registers differ than the two sets may differ in
elements, which is exact.  Shingles are told apart by 64-bit hashes, and so are the
documents that stand for a set.

Rows: null texts, and such without words, have an empty set and are their own component.
With fewer than four words the whole sequence is the one shingle.  A null ``doc_id``
takes part, but names a component only if no other member can.  Rows with one doc_id are
documents of their own and share nothing but the id.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelens.llm.common import lower_words, map_rows, written
from gatelens.llm.simhash import components
from gatelens.session import fresh_path

SHINGLE_WORDS = 4
PERCENT = 80  # least intersection, of the union
BUCKETS, MANTISSA = 256, 10
BANDS, BAND, SHORT_BAND = 51, 5, 2
SHORT = 8  # sketches with at most so many occupied registers get short bands too
SIGMAS = 5
HUB_ROUNDS = 3
CELL_ROWS = 1024  # members of a cell compared at a time
BITS_PER_NODE, MOST_BITS = 16, 1 << 28  # of the bitmap that tells which texts are needed: 32 MB at most
EMPTY = 0xFFFF
_HASH_BITS = 52  # of a hash behind its bucket, as many as a float holds exactly
_ORDERS = np.argsort(np.random.Generator(np.random.PCG64(13)).random((BANDS, BUCKETS)), axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mixed(h + one[k : k + n])
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: leading zeros and mantissa of each bucket's least hash, or ``EMPTY``."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.nonzero(np.diff(bucket, prepend=-1))[0]
    rest = ((hashes[first] >> np.uint64(56 - _HASH_BITS)) & np.uint64((1 << _HASH_BITS) - 1)).astype(np.float64)
    mantissa, length = np.frexp(rest)  # rest = mantissa * 2**length, mantissa in [0.5, 1)
    zeros = np.where(rest > 0, _HASH_BITS - length, _HASH_BITS)
    behind = np.where(rest > 0, np.floor((2 * mantissa - 1) * (1 << MANTISSA)), 0)
    out[bucket[first]] = zeros.astype(np.int64) << MANTISSA | behind.astype(np.int64)
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """Cells of a sketch: hashes of its first occupied registers along each order."""
    occupied = sketch != EMPTY
    count = int(occupied.sum())
    if not count:
        return np.empty(0, np.int64)
    values = _mixed((np.arange(BUCKETS, dtype=np.uint64) << np.uint64(16)) + sketch.astype(np.uint64) + np.uint64(1))
    lengths = [BAND, SHORT_BAND] if count <= SHORT else [BAND]
    # The front of the orders mostly holds enough occupied registers.
    front = min(BUCKETS, 2 * BAND * BUCKETS // count)
    rank = np.cumsum(occupied[_ORDERS[:, :front]], axis=1)
    if front < BUCKETS and (rank[:, -1] < BAND).any():
        front, rank = BUCKETS, np.cumsum(occupied[_ORDERS], axis=1)
    orders, out = _ORDERS[:, :front], []
    for length in lengths:
        taken = occupied[orders] & (rank <= length)
        own = np.where(taken, values[orders], np.uint64(0)).sum(axis=1, dtype=np.uint64)
        out.append(_mixed(own + np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * length)))
    return np.concatenate(out).view(np.int64)


@functools.lru_cache(maxsize=None)
def _chance(quarters: int) -> float:
    """Odds that registers of two independent sets of 2**(quarters / 4) elements agree, where one is occupied."""
    rate = 2.0 ** (quarters / 4) / BUCKETS
    zeros = np.arange(_HASH_BITS)[:, None]
    low = (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) * 0.5 ** (zeros + 1)
    odds = np.exp(-rate * low) * -np.expm1(-rate * 0.5 ** (zeros + 1 + MANTISSA))
    return float(np.square(odds).sum() / -math.expm1(-2 * rate))


def chance(sizes: np.ndarray) -> np.ndarray:
    return np.array([_chance(q) for q in np.rint(4 * np.log2(np.maximum(sizes, 1))).astype(int).tolist()])


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate without chance agreements, registers that differ) of rows of sketches."""
    same = a == b
    differ = (~same).sum(axis=1)
    union = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    odds = chance(np.sqrt(size_a.astype(float) * size_b))
    return ((union - differ) / np.maximum(union, 1) - odds) / (1 - odds), differ


def may_be_near(a, b, size_a, size_b, percent: int = PERCENT) -> np.ndarray:
    """Whether sketches and sizes allow the least similarity."""
    least = percent / 100
    guess, differ = estimate(a, b, size_a, size_b)
    slack = SIGMAS * math.sqrt(least * (1 - least) / BUCKETS)
    # With intersection over union at least p, the sets differ in at most (1 - p) / (1 + p) of their sizes' sum.
    fits = differ * (100 + percent) <= (100 - percent) * (size_a + size_b)
    return fits & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (guess >= least - slack)


# -- nodes and cells -----------------------------------------------------------------


def signatures(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, place, n, high, low, sketch) of every document; ``place`` is a hash of id and text."""

    def run(batch: pa.RecordBatch) -> list:
        sizes, digests, sketches = [], [], []
        for text in batch.column(2).to_pylist():
            own = shingle_set(lower_words(text), size)
            sizes.append(len(own))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            sketches.append(registers(own).tobytes())
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return [batch.column(0), batch.column(1), sizes, pa.array(halves[:, 0]), pa.array(halves[:, 1]), sketches]

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), "text")
    return map_rows(keyed, run, f"doc_id {kind}, place long, n long, high long, low long, sketch binary")


def _nodes(own: DataFrame) -> DataFrame:
    """(node, high, low, least, sketch), one row per distinct set; a node is the place of a document that has it."""
    found = own.filter("n > 0").groupBy("high", "low").agg(
        F.min("place").alias("node"), F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")
    )
    return written(found, "set-nodes")


def _cells(nodes: DataFrame) -> DataFrame:
    """(cell, node, turn) of all cells with several nodes; ``turn`` is the hub round of the cell's band."""

    def run(batch: pa.RecordBatch) -> list:
        own = [bands(np.frombuffer(s, np.uint16)) for s in batch.column(1).to_pylist()]
        lengths = [len(b) for b in own]
        turns = np.concatenate([np.arange(n) % HUB_ROUNDS for n in lengths]).astype(np.int32)
        rows = np.repeat(np.arange(len(own)), lengths)
        return [pa.array(np.concatenate(own)), batch.column(0).take(pa.array(rows)), pa.array(turns)]

    every = map_rows(nodes.select("node", "sketch"), run, "cell long, node long, turn int")
    # Hardly a cell has two members in one task, so counts per task would save nothing: the rows are shuffled once.
    members = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    return written(every.withColumn("members", members).filter("members > 1").drop("members"), "cells")


def _perhaps(rows: DataFrame, needed: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose ``node`` is in ``needed``, and a few others, without a shuffle of ``rows``.

    The needed nodes are bits of a bitmap of bounded size, which is broadcast; others
    pass by chance, more of them where ``most_bits`` are few for the needed.
    """
    bits = min(most_bits, 1 << max(15, (BITS_PER_NODE * needed.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64("node"), F.lit(bits))
    marks = needed.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    # By part first: a task makes whole bitmaps of its parts, not sparse ones of all.
    maps = marks.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    asked = rows.withColumn("part", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place).cast("int"))
    byte = F.conv(F.hex(F.substring("map", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, F.pmod("bit", F.lit(8))) == 1
    return asked.join(F.broadcast(maps), "part").filter(there).select(*rows.columns)


def _full(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(node, n, sketch, hashes) of the nodes that have partners at all, in buckets by node."""

    def run(batch: pa.RecordBatch) -> list:
        sets = [shingle_set(lower_words(t), size) for t in batch.column(1).to_pylist()]
        sketches = [registers(s).tobytes() for s in sets]
        return [batch.column(0), [len(s) for s in sets], sketches, [s.tobytes() for s in sets]]

    spark = docs.sparkSession
    texts = _perhaps(docs.select(F.xxhash64("doc_id", "text").alias("node"), "text"), needed)
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    rows = map_rows(texts.join(needed, "node", "left_semi"), run, "node long, n long, sketch binary, hashes binary")
    name, buckets = f"full_sets_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "full-sets")
    rows.write.bucketBy(buckets, "node").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


# -- pairs -----------------------------------------------------------------------------


def _side(table: DataFrame, side: str) -> DataFrame:
    own = [c for c in ("n", "sketch", "hashes") if c in table.columns]
    return table.select(F.col("node").alias(side), F.struct(*own).alias(f"own_{side}"))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _near(both: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sketches, where they are given, allow and full sets confirm."""

    compared = "sketch" in both.schema["own_a"].dataType.names

    def run(batch: pa.RecordBatch) -> list:
        x, y = batch.column(2), batch.column(3)
        possible = np.ones(batch.num_rows, bool)
        if compared:
            n_x, n_y = x.field("n").to_numpy(), y.field("n").to_numpy()
            possible = may_be_near(_sketches(x.field("sketch")), _sketches(y.field("sketch")), n_x, n_y, percent)
        near = np.zeros(batch.num_rows, bool)
        sets_x, sets_y = x.field("hashes"), y.field("hashes")
        for i in np.nonzero(possible)[0].tolist():
            one, two = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (sets_x, sets_y))
            common = len(np.intersect1d(one, two, assume_unique=True))
            near[i] = 100 * common >= percent * (len(one) + len(two) - common)
        keep = pa.array(near)
        return [batch.column(0).filter(keep), batch.column(1).filter(keep)]

    return map_rows(both.select("a", "b", "own_a", "own_b"), run, "a long, b long")


def _hub_links(cells: DataFrame, full: DataFrame, turn: int, percent: int) -> DataFrame:
    """Confirmed (a, b) of each node b with the hub it shares most cells with, of those outside its component."""
    hub = F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("hub")
    hubs = cells.groupBy("cell").agg(hub, F.min("root").alias("least"), F.max("root").alias("most"))
    pairs = cells.join(hubs.filter("least <> most").select("cell", "hub"), "cell").filter("root <> hub.root")
    mine = pairs.select(F.col("node").alias("b"), F.col("hub.node").alias("a")).repartition("b")
    shared = mine.groupBy("b", "a").agg(F.count(F.lit(1)).alias("cells"))
    best = shared.groupBy("b").agg(F.max_by("a", F.struct("cells", F.xxhash64("a", F.lit(turn)))).alias("a"))
    pairs = written(best, "hub-pairs")
    # Every node is one b at most; hubs are few, and a busy one is split by the adaptive join.
    own_hubs = written(full.join(pairs.select(F.col("a").alias("node")).distinct(), "node"), "hubs")
    return _near(pairs.join(_side(full, "b"), "b").join(_side(own_hubs, "a"), "a"), percent)


def _dealt(cells: DataFrame, cell_rows: int) -> DataFrame:
    """(cell, pair, block, node, root) of cells with several components, once for each pair of blocks to be compared."""
    several = cells.groupBy("cell").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count(F.lit(1)) / cell_rows).alias("blocks")
    )
    several = written(several.filter("least <> most").select("cell", "blocks"), "open-cells")
    return (
        cells.join(several, "cell")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        .select("cell", "pair", "block", "node", "root")
    )


def _rest_pairs(dealt: DataFrame, full: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) between components within a cell whose sketches allow the least similarity, and what has such pairs.

    All of them, or the pairs with the best estimates that span what they connect.
    The second table is ``dealt`` without roots and without the nodes that are in no
    possible pair: components only grow, so these never will be.
    """
    rows = dealt.join(full.select("node", "n", "sketch"), "node")
    ordered = rows.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "block")

    def group(table: pa.Table) -> list[np.ndarray]:
        block, node, root, n = (table.column(k).to_numpy() for k in ("block", "node", "root", "n"))
        sketch = _sketches(table.column("sketch"))
        two = block[0] != block[-1]
        i_all, j_all, guesses = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for i in range(len(node) - 1):
            later = np.arange(i + 1, len(node))
            later = later[(root[later] != root[i]) & ((block[later] != block[i]) if two else True)]
            later = later[100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i])]
            later = later[may_be_near(sketch[[i]], sketch[later], n[[i]], n[later], percent)]
            i_all.append(np.full(len(later), i))
            j_all.append(later)
            guesses.append(estimate(sketch[[i]], sketch[later], n[[i]], n[later])[0])
        i, j, guess = (np.concatenate(c) for c in (i_all, j_all, guesses))
        cell, pair = (table.column(k)[0].as_py() for k in ("cell", "pair"))
        here = _first_shared(sketch, i, j, cell)  # other cells of a pair leave it out
        i, j, guess = i[here], j[here], guess[here]
        used = np.empty(0, np.int64) if every else np.unique(np.concatenate([i, j]))
        turned = root[i] > root[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        if not every and len(i):
            order = np.lexsort((-guess, root[j], root[i]))
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(root[i][order]) != 0) | (np.diff(root[j][order]) != 0)
            best = order[first]
            best = best[np.argsort(-guess[best], kind="stable")]
            keep = best[_spanning(root[i[best]].tolist(), root[j[best]].tolist())]
            i, j, guess = i[keep], j[keep], guess[keep]
        # First the pairs, then the nodes in any; the latter have no guess.
        none, size = np.zeros(len(used), np.int64), len(i) + len(used)
        return [
            np.concatenate([node[i], node[used]]),
            np.concatenate([node[j], none]),
            np.concatenate([root[i], none]),
            np.concatenate([root[j], none]),
            np.concatenate([guess, np.full(len(used), np.nan)]),
            np.full(size, cell),
            np.full(size, pair),
            np.concatenate([block[i], block[used]]),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            parts = held if batch is None else [*held, batch]
            if not parts or (batch is not None and not batch.num_rows):
                continue
            table = pa.Table.from_batches(parts)
            cell, pair = table.column("cell").to_numpy(), table.column("pair").to_numpy()
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])
            starts = np.append(np.nonzero(new)[0], len(cell))
            held = [] if batch is None else table.slice(int(starts[-2])).to_batches()
            groups = [table.slice(at, to - at) for at, to in itertools.pairwise(starts[: None if batch is None else -1].tolist())]
            columns = [np.concatenate(c) for c in zip(*[group(g.combine_chunks()) for g in groups], strict=True)]
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "a long, b long, root_a long, root_b long, guess double, cell long, pair long, block long"
    names = [f.split()[0] for f in schema.split(", ")]
    found = written(ordered.mapInArrow(run, schema), "rest-candidates")
    still = found.filter(F.isnan("guess")).select("cell", "pair", "block", F.col("a").alias("node"))
    found = found.filter(~F.isnan("guess"))
    if every:
        return found.select("a", "b").distinct(), still
    best = F.max_by(F.struct("a", "b"), F.struct("guess", "a", "b")).alias("best")
    return found.groupBy("root_a", "root_b").agg(best).select("best.*"), still


def _first_shared(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
    """Whether ``cell`` is the first that the sketches of a pair have in common."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    rows = np.empty((len(used), 2 * BANDS), np.int64)
    for k, u in enumerate(used.tolist()):
        own = bands(sketches[u])
        rows[k, : len(own)], rows[k, len(own) :] = own, -1 - k  # what is not there equals nothing
    x, y = at[: len(i)], at[len(i) :]
    out = np.zeros(len(i), bool)
    for low in range(0, len(i), 1 << 14):
        a, b = x[low : low + (1 << 14)], y[low : low + (1 << 14)]
        first = (rows[a] == rows[b]).argmax(axis=1)
        out[low : low + len(a)] = rows[a, first] == cell
    return out


def _spanning(a: list[int], b: list[int]) -> list[int]:
    """Places of the pairs that connect something not yet connected by those before."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = top(x), top(y)
        if x != y:
            above[x] = y
            keep.append(k)
    return keep


def _rest_links(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The confirmed ones of pairs that sketches allow; only the sets travel."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = written(full.select("node", "hashes").join(named, "node"), "rest-sets")
    return _near(pairs.join(_side(own, "a"), "a").join(_side(own, "b"), "b"), percent)


# -- components ------------------------------------------------------------------------


def near_components(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(doc_id, n, component_id), one row per document.

    ``n`` is the size of its set, ``component_id`` the smallest doc_id reachable over
    links, the document itself included.
    """
    own = written(signatures(docs, size), "signatures")
    nodes = _nodes(own)
    cells = _cells(nodes)
    alone = written(cells.select("node").distinct(), "nodes-with-partners")
    full = _full(docs, alone, size)
    roots = alone.withColumn("root", F.col("node"))
    for turn in range(HUB_ROUNDS):
        rooted = cells.filter(F.col("turn") == turn).join(roots, "node")
        found = written(_hub_links(rooted, full, turn, percent), "hub-links")
        roots = _joined(found, roots)
    dealt = _dealt(cells.join(roots, "node"), cell_rows)
    for every in (False, True):
        while True:
            pairs, still = _rest_pairs(dealt, full, percent, every)
            pairs = written(pairs, "rest-pairs")
            found = written(_rest_links(pairs, full, percent), "rest-links")
            more = not found.isEmpty()
            if more:
                roots = _joined(found, roots)
            if every or not more:
                break
            dealt = still.join(roots, "node")
        dealt = still.join(roots, "node")
        if pairs.isEmpty():
            break
    to = F.coalesce("root", "node")
    placed = written(nodes.join(roots, "node", "left").select("high", "low", "least", to.alias("root")), "placed-sets")
    tops = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(placed.join(tops, "root").select("high", "low", "component_id"), "named-sets")
    linked = own.filter("n > 0").join(named, ["high", "low"]).select("doc_id", "n", "component_id")
    return linked.unionAll(own.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def _joined(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) after more links between nodes."""
    end = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    links = found.join(end("a"), "a").join(end("b"), "b")
    moved = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    moved = written(moved.select(F.col("node").alias("root"), F.col("root").alias("to")).filter("root <> to"), "moved")
    return written(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
