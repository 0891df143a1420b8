"""Replaying a request log against a cache whose entries live a fixed time.

The first request of a key fills the cache, later ones hit until the fill is
``ttl`` old, then the next one fills again.  Which requests fill is a chain: each
fill decides where the next can be.  A key's whole history must not end up in one
task, so the chain is cut by time:

* Buckets are one ttl long, so each holds at most one fill.
* After a pause of at least one ttl the next request fills for certain.  Pauses
  show in the first and last time per bucket, which is all that is needed for
  keys that are seldom used.
* Where buckets follow without a pause, they are cut into segments.  For each
  segment the map from "earliest next fill" on entry to the same on exit is
  computed independently, the small maps are chained per key, and the segments
  are then resolved independently again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelens import settings as cfg

SEGMENT_BUCKETS = 24


def cache_replay(
    log: DataFrame,
    key: str = "prompt_hash",
    ts: str = "ts",
    ttl_s: int = cfg.CACHE_TTL_S,
    request: str = "request_id",
    segment_buckets: int = SEGMENT_BUCKETS,
) -> DataFrame:
    """Add ``status`` (fill or hit) and ``filled_at`` to every request of a log."""
    ttl = ttl_s * 1_000_000
    timed = log.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    timed = timed.withColumn("__b", F.floor(F.col("__t") / F.lit(ttl)).cast("long"))

    # Requests of a key at one instant collapse before anything is shuffled.  All
    # steps below use these points with the same columns and the same filter, so
    # the log is read and shuffled once for all of them.
    points = (
        timed.filter(F.col(key).isNotNull() & F.col("__b").isNotNull())
        .groupBy(F.col(key).alias("k"), F.col("__b").alias("b"), F.col("__t").alias("t"))
        .agg(F.min(request).alias("first_id"))
    )
    buckets = _runs(points, ttl)
    chained = _chained_fills(points, buckets.filter("run_buckets > 1"), ttl, segment_buckets)

    # One row per bucket: its own fill, and the last one before it.  A bucket on
    # its own is filled by its first request.
    alone = F.col("run_buckets") == 1
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    known = (
        buckets.join(chained, ["k", "b"], "left")
        .select(
            "k",
            "b",
            F.when(alone, F.col("lo")).otherwise(F.col("chained")).alias("fill"),
            F.when(alone, F.col("lo_id")).otherwise(F.col("chained_id")).alias("first_id"),
        )
        .withColumn("carried", F.last("fill", ignorenulls=True).over(earlier))
    )
    # Requests without a key or a time stay in, without a status.
    joined = timed.join(known, (F.col(key) == F.col("k")) & (F.col("__b") == F.col("b")), "left")
    current = F.when(F.col("fill") <= F.col("__t"), F.col("fill")).otherwise(F.col("carried"))
    is_fill = (F.col("__t") == F.col("fill")) & (F.col(request) == F.col("first_id"))
    return joined.select(
        *log.columns,
        F.when(is_fill, "fill").when(current.isNotNull(), "hit").alias("status"),
        _as_type(current, log.schema[ts].dataType.simpleString()).alias("filled_at"),
    )


def _as_type(micros: Column, kind: str) -> Column:
    return F.timestamp_micros(micros).cast(kind)


def _runs(points: DataFrame, ttl: int) -> DataFrame:
    """Buckets per key with their first and last instant, grouped into runs without a pause.

    The window holds one row per bucket and key: its size is bounded by the
    time the log spans, not by the number of requests.
    """
    spans = points.groupBy("k", "b").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.min_by("first_id", "t").alias("lo_id")
    )
    in_time = Window.partitionBy("k").orderBy("b")
    pause = F.col("lo") - F.lag("hi").over(in_time)
    starts = F.when(F.coalesce(pause < ttl, F.lit(False)), 0).otherwise(1)
    return (
        spans.withColumn("starts", starts)
        .withColumn("run", F.sum("starts").over(in_time))
        .withColumn("run_buckets", F.count(F.lit(1)).over(Window.partitionBy("k", "run")))
        .withColumn("run_first", F.min("b").over(Window.partitionBy("k", "run")))
        .drop("starts")
    )


def _chained_fills(points: DataFrame, dense: DataFrame, ttl: int, segment_buckets: int) -> DataFrame:
    """(k, b, chained, chained_id): fills within runs of several buckets."""
    segment = F.floor((F.col("b") - F.col("run_first")) / segment_buckets).cast("long")
    places = dense.select(
        "k",
        "b",
        "run",
        "lo_id",
        segment.alias("segment"),
        ((F.col("run_first") + segment * segment_buckets) * F.lit(ttl)).alias("opens"),
    )
    key_type = points.schema["k"].dataType.simpleString()
    cell = ["k", "run", "segment"]
    # Ids travel along although only the last step needs them: with the same
    # columns everywhere, the shuffle of the points is computed once and reused.
    instants = points.join(places, ["k", "b"]).select(
        *cell, "opens", "b", "t", "first_id", "lo_id"
    )
    id_type = points.schema["first_id"].dataType.simpleString()

    def transition(table: pa.Table) -> pa.Table:
        entry, leave = _segment_map(_sorted(table, "t"), table.column("opens")[0].as_py(), ttl)
        head = {c: table.column(c).slice(0, 1) for c in cell}
        return pa.table({**head, "entry": pa.array([entry]), "leave": pa.array([leave])})

    maps = instants.groupBy(*cell).applyInArrow(
        transition,
        f"k {key_type}, run long, segment long, entry array<long>, leave array<long>",
    )

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        due, dues = np.iinfo(np.int64).min, []
        for entry, leave in zip(table.column("entry"), table.column("leave"), strict=True):
            dues.append(due)
            at = int(np.searchsorted(np.asarray(entry.values), due))
            due = due if at == len(entry) else leave[at].as_py()
        return pa.table(
            {**{c: table.column(c) for c in cell}, "due": pa.array(dues, pa.int64())}
        )

    entries = maps.groupBy("k", "run").applyInArrow(
        chain, f"k {key_type}, run long, segment long, due long"
    )

    def resolve(table: pa.Table) -> pa.Table:
        table, fills = table.sort_by("t"), []
        times = table.column("t").to_numpy()
        at = int(np.searchsorted(times, table.column("due")[0].as_py()))
        while at < len(times):
            fills.append(at)
            at = int(np.searchsorted(times, times[at] + ttl))
        found = table.take(pa.array(fills, pa.int64()))
        return found.select(["k", "b", "t", "first_id"]).rename_columns(
            ["k", "b", "chained", "chained_id"]
        )

    # Joining on the grouping keys keeps the partitioning of the instants.
    return (
        instants.join(entries, cell)
        .groupBy(*cell)
        .applyInArrow(resolve, f"k {key_type}, b long, chained long, chained_id {id_type}")
    )


def _sorted(table: pa.Table, column: str) -> np.ndarray:
    return np.sort(table.column(column).to_numpy())


def _segment_map(times: np.ndarray, opens: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of a segment: due time on entry -> due time on leaving.

    An entry value stands for all due times after the previous one up to it.
    Every chain of fills is followed to its end by doubling the jumps.
    """
    n = len(times)
    after = np.searchsorted(times, times + ttl)
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # The due time on entry is at most one ttl after the opening.
    reach = min(n, int(np.searchsorted(times, opens + ttl)) + 1)
    entry, leave = times[:reach], times[last[:reach]] + ttl
    keep = np.append(leave[1:] != leave[:-1], True)
    return entry[keep], leave[keep]
