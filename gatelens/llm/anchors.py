"""Vector codes: one byte per vector part, from codebooks fitted in whole numbers over all vectors.

Components become ``floor(SCALE * x)``; a vector is cut into ``PARTS`` equal parts, and
each part position has a codebook of ``ENTRIES`` entries, fitted by ``ROUNDS`` rounds of
assignment and integer means.  Codes are exact: nothing is sampled or approximated.

The vectors of a task are dealt into blocks, and for each part position of a block an
anchors hierarchy is built once and written: anchors claim the points nearest to them,
taking from each other only points beyond half the distance between two anchors; from
this middle level balls are merged upwards, and their points are the leaves.  A ball
knows centre, radius, count and the sum of its points.  A round walks down the trees
with a list of candidate entries that children inherit: an entry that no point of the
ball can prefer leaves the list, and a ball with one candidate left gives its cached sum
and count without its points being looked at.  Only sums per entry leave a task, so
what the driver sees is the size of the codebooks, and since sums of whole numbers do
not depend on order or blocks, the result is the same on every partitioning.

Rows: null vectors go, and such with a null or non-finite component or with none at all.
Rows with one vec_id are several vectors; of them the least is a first entry.  Null ids
come last in that order.  With fewer ids than entries the codebooks are smaller.  A
vector whose length differs from the first entry's, or cannot be cut evenly, is an error,
and so is a component beyond ``LARGEST`` after scaling, as its squares would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from gatelens.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 26
BLOCK_ROWS = 2048  # vectors of one hierarchy
LEAF_ROWS = 64  # a ball of at most so many points is not cut further


# -- building a hierarchy ------------------------------------------------------------


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def _claims(points: np.ndarray, count: int) -> list[np.ndarray]:
    """The points dealt to ``count`` anchors: lists of places, each point with its nearest anchor."""
    owner, far = np.zeros(len(points), np.int64), _distances(points, points[0])
    anchors = [0]
    while len(anchors) < count:
        new = int(far.argmax())
        if far[new] <= 0:
            break
        apart = _distances(points[anchors], points[new])
        look = np.nonzero(far > apart[owner] / 2)[0]  # others cannot be nearer to the new anchor
        to_new = _distances(points[look], points[new])
        moves = to_new < far[look]
        far[look[moves]] = to_new[moves]
        owner[look[moves]] = len(anchors)
        anchors.append(new)
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.searchsorted(owner[order], np.arange(1, len(anchors))))


@dataclass
class Ball:
    """Places of its points, their sum, and the two balls it was merged from or cut into."""

    places: np.ndarray
    total: np.ndarray
    parts: tuple[Ball, ...] = ()


def _merged(balls: list[Ball], points: np.ndarray) -> Ball:
    """The balls joined two by two, those first whose joint ball is least."""
    k, size = len(balls), points.shape[1]
    alive = list(balls)
    n = np.array([len(b.places) for b in balls], float)
    sums = np.array([b.total for b in balls], float).reshape(k, size)
    centres = sums / n[:, None]
    radii = np.array([_distances(points[b.places], c).max() for b, c in zip(balls, centres, strict=True)])
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    wide = apart + radii[:, None] + radii[None]
    wide[np.arange(k), np.arange(k)] = np.inf
    for _ in range(k - 1):
        i, j = sorted(divmod(int(wide.argmin()), k))
        a, b = alive[i], alive[j]
        alive[i] = Ball(np.concatenate([a.places, b.places]), a.total + b.total, (a, b))
        n[i] += n[j]
        sums[i] += sums[j]
        middle = sums[i] / n[i]
        radii[i] = (_distances(centres[[i, j]], middle) + radii[[i, j]]).max()
        centres[i] = middle
        wide[j], wide[:, j] = np.inf, np.inf
        others = np.isfinite(wide[i])
        others[i] = False
        row = np.where(others, _distances(centres, middle) + radii + radii[i], np.inf)
        wide[i], wide[:, i] = row, row
        if not others.any():
            return alive[i]
    return alive[0]


def _grown(places: np.ndarray, points: np.ndarray, floats: np.ndarray) -> Ball:
    """The hierarchy of some points: anchors in the middle, merged above and cut again below."""
    if len(places) > LEAF_ROWS:
        groups = _claims(floats[places], int(np.sqrt(len(places))))
        if len(groups) > 1:  # else all points are equal
            return _merged([_grown(places[g], points, floats) for g in groups], floats)
    return Ball(places, points[places].sum(axis=0, dtype=np.int64))


def hierarchy(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, balls) of whole-number points.

    ``order`` lists places so that each ball is a run of it.  A row of ``balls`` holds
    first, stop, left, right (0 for a leaf), and then the sum; the first row is the root.
    """
    rows: list[tuple] = []
    order: list[np.ndarray] = []
    at = 0
    root = _grown(np.arange(len(points)), points, points.astype(float))
    stack = [(root, -1, 0)]
    while stack:  # depth first, so that leaves come in the order of their runs
        ball, above, side = stack.pop()
        if above >= 0:
            rows[above][side] = len(rows)
        rows.append([at, at + len(ball.places), 0, 0, *ball.total.tolist()])
        if ball.parts:
            left, right = ball.parts
            stack += [(right, len(rows) - 1, 3), (left, len(rows) - 1, 2)]
        else:
            order.append(ball.places)
            at += len(ball.places)
    return np.concatenate(order), np.array(rows, np.int64)


def radii(points: np.ndarray, balls: np.ndarray) -> np.ndarray:
    """Upper bounds of the distances between each ball's mean and its points; ``points`` in the balls' order."""
    centres = balls[:, 4:] / (balls[:, 1] - balls[:, 0])[:, None]
    out = [_distances(points[a:b], c).max() for (a, b), c in zip(balls[:, :2].tolist(), centres, strict=True)]
    return np.array(out) * (1 + 1e-9) + 1e-6


# -- walking down --------------------------------------------------------------------


def owned(points: np.ndarray, balls: np.ndarray, radius: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """What entries own: entries and numbers of whole balls, then entries and places of single points.

    Balls of one level go together.  Entry e leaves a ball's list if
    d2(centre, e) - d2(centre, best) > 2 * radius * |e - best|: then every point is
    strictly nearer to the best entry, as the difference of squares is linear in the point.
    """
    e = entries.astype(float)
    gaps = np.sqrt(((e[:, None] - e[None]) ** 2).sum(axis=2))
    norms = np.square(e).sum(axis=1)
    front, lists = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    whole, singles = [], []
    while len(front):
        own = balls[front]
        centres = own[:, 4:] / (own[:, 1] - own[:, 0])[:, None]
        d2 = norms - 2 * (centres @ e.T) + np.square(centres).sum(axis=1)[:, None]
        rows = np.arange(len(front))
        best = np.where(lists, d2, np.inf).argmin(axis=1)
        slack = 1e-6 + 1e-9 * (norms + norms[best][:, None] + np.square(centres).sum(axis=1)[:, None])
        lists &= ~(d2 - d2[rows, best][:, None] > 2 * radius[front][:, None] * gaps[best] + slack)
        single = lists.sum(axis=1) == 1
        whole.append((best[single], front[single]))
        leaf = ~single & (own[:, 2] == 0)
        size = own[leaf, 1] - own[leaf, 0]
        first = np.repeat(own[leaf, 0] - np.cumsum(size) + size, size)
        singles.append((np.repeat(lists[leaf], size, axis=0), np.arange(size.sum()) + first))
        inner = ~single & ~leaf
        front = np.concatenate([own[inner, 2], own[inner, 3]])
        lists = np.concatenate([lists[inner], lists[inner]])
    places = np.concatenate([p for _, p in singles])
    far = squares(points[places], entries)
    far[~np.concatenate([m for m, _ in singles])] = np.iinfo(np.int64).max
    by, runs = (np.concatenate(c) for c in zip(*whole, strict=True))
    return by, runs, far.argmin(axis=1), places


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    most = max(abs(int(x.min())) + abs(int(x.max())) for x in (points, entries)) if points.size else 0
    if 4 * most * most * points.shape[1] < 1 << 52:  # then floats are exact, and faster
        p, e = points.astype(float), entries.astype(float)
        return (np.square(p).sum(axis=1)[:, None] - 2 * (p @ e.T) + np.square(e).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None].astype(np.int64) - entries[None, :, k]) ** 2
    return out


def _summed(rows: np.ndarray, who: np.ndarray, entries: int) -> np.ndarray:
    """Sums of whole-number rows by their entry."""
    return (np.arange(entries)[:, None] == who).astype(np.int64) @ rows.astype(np.int64)


def sums_of(points, balls, radius, entries) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the points nearest to each entry, ties to the lower one."""
    by, runs, who, places = owned(points, balls, radius, entries)
    own, k = balls[runs], len(entries)
    sums = _summed(own[:, 4:], by, k) + _summed(points[places], who, k)
    return sums, _summed(own[:, 1] - own[:, 0], by, k) + np.bincount(who, minlength=k)


def codes_of(points, balls, radius, entries) -> np.ndarray:
    """The nearest entry of every point."""
    by, runs, who, places = owned(points, balls, radius, entries)
    out = np.empty(len(points), np.int64)
    for entry, (a, b) in zip(by.tolist(), balls[runs, :2].tolist(), strict=True):
        out[a:b] = entry
    out[places] = who
    return out


# -- over all vectors ----------------------------------------------------------------


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.filter((F.size(vector) > 0) & F.forall(vector, fine))


def _whole(vector: str):
    """The vector in whole numbers; scaling by a power of two is exact."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def _checked(lengths: np.ndarray, components: np.ndarray, size: int) -> np.ndarray:
    if (lengths != size).any():
        raise ValueError(f"vectors of other lengths than {size} cannot share codebooks")
    rows = components.reshape(len(lengths), size)
    if len(rows) and max(abs(int(rows.min())), abs(int(rows.max()))) > LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE} cannot be coded")
    return rows


def first_entries(vectors: DataFrame, key: str, vector: str) -> np.ndarray:
    """The vectors of the least keys, in whole numbers: (entries, components)."""
    kept = _kept(vectors, vector).select(F.col(key).alias("key"), _whole(vector).alias("whole"))
    least = kept.select("key").distinct().orderBy(F.col("key").asc_nulls_last()).limit(ENTRIES).collect()
    named = [r.key for r in least if r.key is not None]
    wanted = F.col("key").isin(named) if named else F.lit(False)
    if len(named) < len(least):
        wanted = wanted | F.col("key").isNull()
    rows = kept.filter(wanted).groupBy("key").agg(F.min("whole").alias("whole")).collect()
    rows.sort(key=lambda r: (r.key is None, r.key if r.key is not None else 0))
    size = len(rows[0].whole) if rows else 0
    if size % PARTS:
        raise ValueError(f"vectors of {size} components cannot be cut into {PARTS} parts")
    lengths = np.array([len(r.whole) for r in rows], np.int64)
    return _checked(lengths, np.array([x for r in rows for x in r.whole], np.int64), size)


def hierarchies(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """One row per block: the vectors' other columns and, for each part, points and balls as bytes."""
    rest = [c for c in vectors.columns if c != vector]
    kept = _kept(vectors, vector).select(F.struct(*rest).alias("rest"), _whole(vector).alias("whole"))
    row = kept.schema["rest"].dataType
    schema = StructType.fromDDL("points binary, orders binary, balls array<binary>, radii array<binary>")
    schema = schema.add("rest", ArrayType(row))
    whole_schema = to_arrow_schema(schema)

    def block(table: pa.Table) -> pa.RecordBatch:
        lists = table.column(1).combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        whole = _checked(np.diff(lists.offsets.to_numpy()), flat, size)
        points, orders, balls, wide = [], [], [], []
        for part in np.split(whole, PARTS, axis=1):
            order, own = hierarchy(part)
            points.append(part[order].astype(np.int32))
            orders.append(order.astype(np.int32))
            balls.append(own.tobytes())
            wide.append(radii(part[order].astype(float), own).tobytes())
        columns = [b"".join(p.tobytes() for p in points), b"".join(o.tobytes() for o in orders), balls, wide]
        arrays = [pa.array([c], f.type) for c, f in zip(columns, whole_schema, strict=False)]
        others = table.column(0).combine_chunks()
        listed = pa.ListArray.from_arrays(pa.array([0, len(others)], pa.int32()), others)
        return pa.RecordBatch.from_arrays([*arrays, listed.cast(whole_schema.field("rest").type)], schema=whole_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK_ROWS))
                held, rows = table.slice(BLOCK_ROWS).to_batches(), rows - BLOCK_ROWS
        if rows:
            yield block(pa.Table.from_batches(held))

    return kept.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, row: int, width: int) -> Iterator[tuple]:
    """(points, balls, radii) of each part of a block."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[row]
    points = np.frombuffer(get("points").as_buffer(), np.int32).reshape(PARTS, -1, width)
    for k in range(PARTS):
        balls = np.frombuffer(get("balls")[k].as_buffer(), np.int64).reshape(-1, 4 + width)
        yield points[k], balls, np.frombuffer(get("radii")[k].as_buffer(), np.float64)


def next_entries(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; ``books`` is (parts, entries, width)."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for k, (points, balls, radius) in enumerate(_parts(batch, row, width)):
                    s, n = sums_of(points, balls, radius, books[k])
                    sums[k] += s
                    counts[k] += n
        if counts.any():
            cells = np.concatenate([sums, counts[:, :, None]], axis=2).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size, dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    found = blocks.drop("rest", "orders").mapInArrow(run, "cell int, n long")
    totals = found.groupBy("cell").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    cells = {r.cell: int(r.n) for r in totals}
    at = lambda k, e, c: cells.get((k * entries + e) * (width + 1) + c, 0)
    out = books.copy()
    for k in range(parts):
        for e in range(entries):
            if n := at(k, e, width):
                out[k, e] = [at(k, e, c) // n for c in range(width)]
    return out


def coded(blocks: DataFrame, books: np.ndarray, result: str) -> DataFrame:
    """The other columns of every vector, and a struct ``result`` with ``code`` and ``error``."""
    width = books.shape[2]
    row = blocks.schema["rest"].dataType.elementType
    fields = [f for f in row if f.name != result]
    schema = StructType([*fields, StructField(result, StructType.fromDDL("code string, error long"))])
    whole = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("rest"))
            for r in range(batch.num_rows):
                others = lists[r].values
                codes, error = np.empty((len(others), PARTS), np.uint8), np.zeros(len(others), np.int64)
                orders = np.frombuffer(batch.column(batch.schema.get_field_index("orders"))[r].as_buffer(), np.int32)
                for k, (points, balls, radius) in enumerate(_parts(batch, r, width)):
                    order = orders.reshape(PARTS, -1)[k]
                    own = codes_of(points, balls, radius, books[k])
                    codes[order, k] = own
                    error[order] += ((points.astype(np.int64) - books[k][own]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                hexes = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                found = pa.StructArray.from_arrays([pa.array(hexes, pa.string()), pa.array(error)], ["code", "error"])
                columns = [others.field(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, found], schema=whole)

    return blocks.mapInArrow(run, schema)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", result: str = "pq"
) -> tuple[DataFrame, np.ndarray]:
    """The kept vectors' other columns with a struct ``result`` (code, error), and the codebooks.

    Codebooks have the shape (parts, entries, components of a part).  An extra column
    named like ``result`` is replaced.
    """
    start = first_entries(vectors, key, vector)
    books = np.stack(np.split(start, PARTS, axis=1))
    blocks = written(hierarchies(vectors, vector, start.shape[1]), "hierarchies")
    for _ in range(ROUNDS if len(start) else 0):
        books = next_entries(blocks, books)
    return coded(blocks, books, result), books
