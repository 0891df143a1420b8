"""Best stored vector per query above a similarity threshold, searched exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens import settings as cfg

QUERIES_PER_GROUP = 20_000
INDEX_PER_BLOCK = 10_000
_SCORES_PER_STEP = 1_000_000  # cells of one score matrix held at a time
_ROWS_PER_STEP = 1_000  # vectors made unit vectors at a time
_TIE = 1e-12
_ALWAYS = (-(1 << 63), (1 << 63) - 1)  # an entry without times, in microseconds


def semantic_top1(
    queries: DataFrame,
    index: DataFrame,
    threshold: float = cfg.SIMILARITY_THRESHOLD,
    scope: str = "tenant",
    sizing: DataFrame | None = None,
) -> DataFrame:
    """(query_id, seq, score) of the most similar vector, where it reaches ``threshold``.

    Queries hold (query_id, tenant, vector [, arrival]), the index (seq, tenant,
    vector [, stored_at] [, expires_at]); where a query has an arrival, entries
    written after it or dead by then are skipped.  Ties go to the oldest entry.
    Vectors with elements that are null or not finite match nothing, and neither
    do vectors of different lengths.

    The whole index is searched, whatever its size; a cache that evicts entries
    applies ``fifo_bound`` first.  Spark groups the work into (scope, query
    slice, index block) cells of bounded size: the queries of a busy scope are
    sliced, a large index is cut into blocks, and each cell is one matrix
    product.  A cell emits at most one row per query, never pairs.

    Queries are counted per scope first.  Where they are dear to compute twice,
    ``sizing`` is a table with a ``tenant`` column and at least as many rows.
    """
    timed = "arrival" in queries.columns
    by = F.col("tenant") if scope == "tenant" else F.lit("*")
    q, v = asked(queries, by, timed), stored(index, by, timed)
    counted = q if sizing is None else sizing.select(by.alias("scope"))
    v = with_cells(v, counted, QUERIES_PER_GROUP, "slices", scope)
    q = with_cells(q, counted, QUERIES_PER_GROUP, "slices", scope)
    q = with_cells(q, v, INDEX_PER_BLOCK, "blocks", scope).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    v = with_cells(v, v, INDEX_PER_BLOCK, "blocks", scope).withColumn(
        "block", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int")
    )

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_in_cell(left, right, threshold)

    return best_of_cells(q, v, ["block"], best)


def asked(queries: DataFrame, by: Column, timed: bool) -> DataFrame:
    """(scope, query_id, vector, at) of the queries that can match anything."""
    return searchable(queries).select(
        by.alias("scope"),
        "query_id",
        _narrow(queries).alias("vector"),
        _moment("arrival", timed, 0).alias("at"),
    )


def stored(index: DataFrame, by: Column, timed: bool, *others: str) -> DataFrame:
    """(scope, seq, vector, since, until) of the entries that can match anything, and ``others``."""
    return searchable(index).select(
        by.alias("scope"),
        "seq",
        _narrow(index).alias("vector"),
        _moment("stored_at", timed and "stored_at" in index.columns, _ALWAYS[0]).alias("since"),
        _moment("expires_at", timed and "expires_at" in index.columns, _ALWAYS[1]).alias("until"),
        *others,
    )


def _narrow(df: DataFrame) -> Column:
    """Vectors of floats travel as they are, others as doubles; either is computed with as doubles."""
    floats = df.schema["vector"].dataType == T.ArrayType(T.FloatType(), df.schema["vector"].dataType.containsNull)
    return F.col("vector") if floats else F.col("vector").cast("array<double>")


def best_of_cells(
    q: DataFrame,
    v: DataFrame,
    cells: list[str],
    best: Callable[[pa.Table, pa.Table], pa.Table],
    asked_with: tuple[str, ...] = (),
    stored_with: tuple[str, ...] = (),
) -> DataFrame:
    """(query_id, seq, score): the best entry over all cells in which a query meets entries.

    Both sides have ``slices``, into how many the queries of their scope are dealt.
    ``best`` searches one cell; it sees the named columns of either side as well.
    """
    q = q.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int"))
    v = v.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    # Only vectors of one length meet.
    q, v = (side.withColumn("length", F.size("vector")) for side in (q, v))

    cell = ["scope", "length", "slice", *cells]
    id_type = q.schema["query_id"].dataType.simpleString()
    seq_type = v.schema["seq"].dataType.simpleString()
    schema = f"query_id {id_type}, seq {seq_type}, score double"

    best_rows = (
        q.select(*cell, "query_id", "vector", "at", *asked_with)
        .groupBy(*cell)
        .cogroup(v.select(*cell, "seq", "vector", "since", "until", *stored_with).groupBy(*cell))
        .applyInArrow(best, schema)
    )
    # One candidate per cell: the best score wins, on a tie the oldest entry.
    winner = F.max_by(F.struct("seq", "score"), F.struct(F.round("score", 12), -F.col("seq")))
    return best_rows.groupBy("query_id").agg(winner.alias("w")).select("query_id", "w.*")


def searchable(df: DataFrame) -> DataFrame:
    """Rows with a vector of finite numbers."""
    big = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < big, F.lit(False)))
    return df.filter((F.size("vector") > 0) & finite)


def _moment(column: str, known: bool, otherwise: int) -> Column:
    return (F.unix_micros(F.col(column).cast("timestamp")) if known else F.lit(otherwise)).cast("long")


def with_cells(df: DataFrame, counted: DataFrame, size: int, name: str, scope: str) -> DataFrame:
    """Add into how many cells of ``size`` rows a scope of ``counted`` has to be cut.

    Only scopes beyond one cell are in the joined table.  It is not hinted: the
    adaptive planner knows its size and broadcasts it when it is small.
    """
    cells = F.ceil(F.col("n") / size).cast("int").alias(name)
    if scope != "tenant":
        return df.withColumn(
            name, F.greatest(F.lit(1), counted.agg(F.count(F.lit(1)).alias("n")).select(cells).scalar())
        )
    large = counted.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size)
    return df.join(large.select("scope", cells), "scope", "left").withColumn(
        name, F.coalesce(name, F.lit(1))
    )


def unit_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    rows = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)
    for start in range(0, len(rows), _ROWS_PER_STEP):  # the one copy is all that is held
        some = rows[start : start + _ROWS_PER_STEP]
        lengths = np.linalg.norm(some, axis=1, keepdims=True)
        np.divide(some, lengths, out=some, where=lengths > 0)
    return rows


def unit_parts(column: pa.ChunkedArray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Unit vectors with the place of the first, so many at a time that ``width`` figures for each stay few."""
    step = max(1, _SCORES_PER_STEP // max(1, width))
    for start in range(0, len(column), step):
        yield start, unit_matrix(column.slice(start, step))


def top_entries(
    wanted: np.ndarray, entries: np.ndarray, at: np.ndarray, since: np.ndarray, until: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the best entry for each wanted vector; of equal ones the first."""
    scores = wanted @ entries.T
    arrived = at[:, None]
    scores[(until[None, :] <= arrived) | (since[None, :] > arrived)] = -np.inf
    top = scores.max(axis=1)
    return np.argmax(scores >= top[:, None] - _TIE, axis=1), top


def _best_in_cell(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    if left.num_rows == 0 or right.num_rows == 0:
        return no_match(left, right)
    right = right.sort_by("seq")  # the first of equal scores is then the oldest
    entries = unit_matrix(right.column("vector"))
    right = right.drop_columns(["vector"])
    since, until = right.column("since").to_numpy(), right.column("until").to_numpy()
    at = left.column("at").to_numpy()
    found, where, scores = [], [], []
    for start, part in unit_parts(left.column("vector"), max(entries.shape)):
        first, top = top_entries(part, entries, at[start : start + len(part)], since, until)
        hit = np.nonzero(top >= threshold)[0]
        found.append(hit + start)
        where.append(first[hit])
        scores.append(top[hit])
    return matched(left, right, np.concatenate(found), np.concatenate(where), np.concatenate(scores))


def matched(left: pa.Table, right: pa.Table, found: np.ndarray, where: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "query_id": left.column("query_id").take(pa.array(found)),
            "seq": right.column("seq").take(pa.array(where)),
            "score": pa.array(scores),
        }
    )


def no_match(left: pa.Table, right: pa.Table) -> pa.Table:
    none = pa.array([], pa.float64())
    return pa.table({"query_id": left.column("query_id").slice(0, 0), "seq": right.column("seq").slice(0, 0), "score": none})
