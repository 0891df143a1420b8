"""Exact search of a large vector index through pivots and angular bounds.

A bounded sample of the index gives pivots.  Every entry belongs to the cell of the pivot
with the smallest angle to it, and a cell knows its smallest and largest angle.  Angles
obey the triangle inequality, so an entry within ``reach`` of a query lies in a cell with

* angle(query, pivot) <= angle(query, nearest pivot) + 2 * reach, and
* angle(query, pivot) between the cell's least angle - reach and its largest + reach.

A query visits the cells that pass both, and no other can hold a match: the result is that
of a full search whatever the pivots are; they only decide how much is left out.  Cells of
near pivots travel together as one part, so that a query is sent once to a part and not once
to each of its cells.  Parts beyond one block of rows are cut into blocks, so a group of
copies is never one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens import settings as cfg
from gatelens.operators import semantic

MOST_PIVOTS = 4096  # what the driver holds and sends to tasks
ROWS_PER_CELL = 10_000
_SLACK = 1e-6  # radians, far above the rounding of an angle
_ROWS_PER_BATCH = 10_000
_NO_PIVOT = -1  # the cell of vectors whose length is not the pivots'


def choose_pivots(index: DataFrame, rows_per_cell: int = ROWS_PER_CELL, most: int = MOST_PIVOTS) -> np.ndarray:
    """Unit vectors of up to ``most`` entries, one per ``rows_per_cell``, in order of a hash of their seq.

    All have the length of the first; without entries the array is empty.
    """
    usable = semantic.searchable(index).filter(F.exists("vector", lambda x: x != 0))
    wanted = min(most, math.ceil(usable.count() / rows_per_cell))
    order = [F.xxhash64("seq"), F.col("seq")]
    first = usable.select("seq", F.col("vector").cast("array<double>").alias("vector")).orderBy(*order).limit(wanted).collect()
    rows = np.array([r.vector for r in first if len(r.vector) == len(first[0].vector)], float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) if len(rows) else np.empty((0, 0))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    angles = unit @ pivots.T
    return np.arccos(np.clip(angles, -1, 1, out=angles), out=angles)


def _by_length(vectors: pa.ListArray, pivots: np.ndarray) -> np.ndarray:
    """Which vectors have the pivots' length."""
    return np.diff(vectors.offsets.to_numpy()) == (pivots.shape[1] if len(pivots) else -1)


def with_pivot(index: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The index's searchable entries with ``pivot`` and ``angle``; columns of these names are replaced.

    Worth writing where an index is searched often.
    """
    rows = semantic.searchable(index.drop("pivot", "angle")).withColumn("vector", F.col("vector").cast("array<double>"))
    schema = rows.withColumn("pivot", F.lit(0)).withColumn("angle", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            own = _by_length(vectors, pivots)
            pivot, angle = np.full(batch.num_rows, _NO_PIVOT, np.int32), np.zeros(batch.num_rows)
            place = np.nonzero(own)[0]
            for start, unit in semantic.unit_parts(pa.chunked_array([vectors.filter(pa.array(own))]), len(pivots)):
                angles, at = _angles(unit, pivots), place[start : start + len(unit)]
                pivot[at], angle[at] = angles.argmin(axis=1), angles.min(axis=1)
            names = [*batch.schema.names, "pivot", "angle"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(angle)], names)

    return rows.mapInArrow(run, schema)


def parts_of(pivots: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """The part of each pivot: that of the nearest of some pivots, one per ``rows`` entries; ``sizes`` are those of the cells."""
    if not len(pivots):
        return np.empty(0, int)
    leaders = pivots[: max(1, math.ceil(sizes.sum() / rows))]
    return np.concatenate([(unit @ leaders.T).argmax(axis=1) for unit in np.array_split(pivots, len(pivots) // 1000 + 1)])


def visits(q: DataFrame, pivots: np.ndarray, rings: DataFrame, reach: float, parts: np.ndarray | None = None) -> DataFrame:
    """The queries, once for every cell of their scope that can hold a match.

    ``rings`` has (scope, pivot, low, high, blocks), the angles in each cell.  The
    widest ring of each pivot over all scopes, at most ``MOST_PIVOTS`` rows, is
    checked first, so that only few rows go into the join.

    With ``parts``, the part of each pivot, a query comes once for every ``part`` with
    such a cell, not joined yet, and has its angle to the nearest pivot as ``nearest``.
    """
    widest = rings.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in widest:
        if r.pivot != _NO_PIVOT:
            low[r.pivot], high[r.pivot] = r.low, r.high
    of, figure = ("pivot", "angle") if parts is None else ("part", "nearest")
    schema = q.withColumn(of, F.lit(0)).withColumn(figure, F.lit(0.0)).schema
    names = [*q.columns, of, figure]
    if parts is not None and len(parts):
        order = np.argsort(parts, kind="stable")
        own_parts, begins = np.unique(parts[order], return_index=True)

    def taken(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, angle: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(row), _ROWS_PER_BATCH):
            some = slice(i, i + _ROWS_PER_BATCH)
            kept = batch.take(pa.array(row[some])).columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cell[some].astype(np.int32)), pa.array(angle[some])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            own = _by_length(vectors, pivots)
            other, place = np.nonzero(~own)[0], np.nonzero(own)[0]
            yield from taken(batch, other, np.full(len(other), _NO_PIVOT), np.zeros(len(other)))
            for start, unit in semantic.unit_parts(pa.chunked_array([vectors.filter(pa.array(own))]), len(pivots)):
                angles = _angles(unit, pivots)
                nearest = angles.min(axis=1)
                near = _near(angles, nearest, low, high, reach)
                if parts is None:
                    at, cell = np.nonzero(near)
                    yield from taken(batch, place[at + start], cell, angles[at, cell])
                else:
                    at, cell = np.nonzero(np.logical_or.reduceat(near[:, order], begins, axis=1))
                    yield from taken(batch, place[at + start], own_parts[cell], nearest[at])

    seen = q.mapInArrow(run, schema)
    if parts is not None:
        return seen
    within = (F.col("angle") >= F.col("low") - reach) & (F.col("angle") <= F.col("high") + reach)
    return seen.join(rings, ["scope", "pivot"]).filter(within).drop("angle", "low", "high")


def _near(angles: np.ndarray, nearest: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
    """Which cells can hold a match, by the angles of queries to pivots and the rings of the cells."""
    near = angles <= nearest[:, None] + 2 * reach
    near &= angles >= low - reach
    near &= angles <= high + reach
    return near


def _best_in_part(left: pa.Table, right: pa.Table, pivots: np.ndarray, threshold: float, reach: float) -> pa.Table:
    """The best entry of one block of a part, cell by cell; a query meets only cells it may visit."""
    if left.num_rows == 0 or right.num_rows == 0:
        return semantic.no_match(left, right)
    right = right.sort_by("seq")  # the first of equal scores is then the oldest
    entries = semantic.unit_matrix(right.column("vector"))
    since, until = right.column("since").to_numpy(), right.column("until").to_numpy()
    pivot, angle = right.column("pivot").to_numpy(), right.column("angle").to_numpy()
    known = np.unique(pivot)
    cells = [np.nonzero(pivot == p)[0] for p in known]
    bounded = known[0] != _NO_PIVOT
    low, high = (np.array([f(angle[c]) for c in cells]) for f in (np.min, np.max))
    at, nearest = left.column("at").to_numpy(), left.column("nearest").to_numpy()
    found, where, scores = [], [], []
    for start, unit in semantic.unit_parts(left.column("vector"), max(entries.shape[1], len(cells), max(map(len, cells)))):
        some = slice(start, start + len(unit))
        near = _near(_angles(unit, pivots[known]), nearest[some], low, high, reach) if bounded else np.ones((len(unit), len(cells)), bool)
        best, score = np.zeros(len(unit), int), np.full(len(unit), -np.inf)
        for i, cell in enumerate(cells):
            asks = np.nonzero(near[:, i])[0]
            if not len(asks):
                continue
            first, top = semantic.top_entries(unit[asks], entries[cell], at[some][asks], since[cell], until[cell])
            first, new, old = cell[first], np.round(top, 12), np.round(score[asks], 12)
            wins = (new > old) | ((new == old) & (first < best[asks]))
            best[asks[wins]], score[asks[wins]] = first[wins], top[wins]
        hit = np.nonzero(score >= threshold)[0]
        found.append(hit + start)
        where.append(best[hit])
        scores.append(score[hit])
    return semantic.matched(left, right, np.concatenate(found), np.concatenate(where), np.concatenate(scores))


def pivot_top1(
    queries: DataFrame,
    index: DataFrame,
    threshold: float = cfg.SIMILARITY_THRESHOLD,
    scope: str = "tenant",
    pivots: np.ndarray | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """``semantic_top1`` with the same rows, looking only into cells that can hold a match.

    An ``index`` that ``with_pivot`` gave is searched as it is, with the ``pivots`` it
    was made with; else pivots are chosen here.  ``threshold`` has to be above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("angular bounds need a threshold above 0 and at most 1")
    if pivots is None:
        pivots = choose_pivots(index, rows_per_cell)
        index = with_pivot(index, pivots)
    timed = "arrival" in queries.columns
    by = F.col("tenant") if scope == "tenant" else F.lit("*")
    reach = math.acos(threshold) + _SLACK
    q, v = semantic.asked(queries, by, timed), semantic.stored(index, by, timed, "pivot", "angle")
    counted = q if sizing is None else sizing.select(by.alias("scope"))
    # The rings, and the sizes of cells over all scopes: at most MOST_PIVOTS rows each on the driver.
    rings = v.groupBy("scope", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("rows"))
    sizes = np.zeros(len(pivots))
    for r in rings.groupBy("pivot").agg(F.sum("rows").alias("rows")).collect():
        if r.pivot != _NO_PIVOT:
            sizes[r.pivot] = r.rows
    rows_per_part = max(rows_per_cell, semantic.INDEX_PER_BLOCK)
    parts = parts_of(pivots, sizes, rows_per_part)
    places = F.array(*[F.lit(int(p)) for p in parts]).cast("array<int>")
    part = F.when(F.col("pivot") == _NO_PIVOT, F.lit(_NO_PIVOT)).otherwise(F.get(places, F.col("pivot"))).alias("part")
    blocks = F.ceil(F.sum("rows") / rows_per_part).cast("int").alias("blocks")
    blocks_of = rings.groupBy("scope", part).agg(blocks)
    q = visits(q, pivots, rings, reach, parts).join(blocks_of, ["scope", "part"])
    q = semantic.with_cells(q, counted, semantic.QUERIES_PER_GROUP, "slices", scope)
    v = semantic.with_cells(v, counted, semantic.QUERIES_PER_GROUP, "slices", scope)
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    v = v.select("*", part).join(blocks_of, ["scope", "part"])
    v = v.withColumn("block", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_in_part(left, right, pivots, threshold, reach)

    return semantic.best_of_cells(q, v, ["part", "block"], best, ("nearest",), ("pivot", "angle"))
