"""Fills and hits of a fixed-lifetime cache over a request stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatelens import settings as cfg
from gatelens.operators.cache import seconds
from gatelens.operators.replay import cache_replay
from gatelens.streaming.log import write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SPAN = 24  # lifetimes
_ROWS_HELD = 100_000  # requests of one key held in memory at a time


class _Fills(StatefulProcessor):
    """When a key's entry was filled, and the requests the watermark has not passed yet.

    Requests wait until none before them can come any more; then they are answered by
    their own times, whatever the order they came in.  They wait in pieces, by spans of
    ``_SPAN`` lifetimes.  The fills of a span follow from its instants alone, and the
    requests are answered piece by piece, so memory does not grow with a key's history.
    """

    def __init__(self, ttl_s: int):
        self._ttl = ttl_s * 1_000_000
        self._span = self._ttl * _SPAN

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._fill = handle.getValueState("fill", "at long")
        self._pieces = handle.getMapState("pieces", "span long", "n long")
        self._waiting = handle.getMapState("waiting", "span long, piece long", "requests binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in rows:
            held.append(pd.DataFrame({"t": batch["t"].astype(int), "id": batch["request_id"].astype(str)}))
            n += len(batch)
            if n >= _ROWS_HELD:
                self._wait(pd.concat(held))
                held, n = [], 0
        if held:
            self._wait(pd.concat(held))
        yield from ()

    def _wait(self, requests: pd.DataFrame) -> None:
        for span, some in requests.groupby(requests["t"] // self._span):
            n = self._n_pieces(int(span))
            self._put(int(span), n, some)
            self._pieces.updateValue((int(span),), (n + 1,))
            self._handle.registerTimer(int(some["t"].max()) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers expire in their order and every span has one after its newest request: earlier spans are answered.
        passed = expiredTimerInfo.getExpiryTimeInMs()
        span = (passed - 1) * 1000 // self._span
        n = self._n_pieces(span)
        before = self._fill.get()[0] if self._fill.exists() else None
        if n:
            fills = self._next_fills(span, n, before, passed * 1000)
            known = np.array([before, *fills] if before is not None else fills)
            left = 0
            for piece in range(n):
                requests = self._get(span, piece)
                due = requests["t"] < passed * 1000
                if due.any():
                    yield self._answered(key[0], requests[due], known)
                if not due.all():
                    self._put(span, left, requests[~due])
                    left += 1
            for piece in range(left, n):
                self._waiting.removeKey((span, piece))
            if left:
                self._pieces.updateValue((span,), (left,))
            else:
                self._pieces.removeKey((span,))
            if fills:
                before = fills[-1]
                self._fill.update((before,))
                self._handle.registerTimer(self._ends(before))
        # An entry that ended before the watermark is of no use.  A younger fill has a timer of its own.
        if before is not None and self._ends(before) <= passed:
            self._fill.clear()

    def _n_pieces(self, span: int) -> int:
        found = self._pieces.getValue((span,))
        return found[0] if found else 0

    def _put(self, span: int, piece: int, requests: pd.DataFrame) -> None:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(requests, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self._waiting.updateValue((span, piece), (sink.getvalue().to_pybytes(),))

    def _get(self, span: int, piece: int) -> pd.DataFrame:
        return pa.ipc.open_stream(bytes(self._waiting.getValue((span, piece))[0])).read_pandas()

    def _ends(self, fill: int) -> int:
        return (fill + self._ttl) // 1000 + 1

    def _next_fills(self, span: int, n: int, before: int | None, until: int) -> list[int]:
        """The instants of a span, earlier than ``until``, at which the entry is filled anew."""
        times = np.empty(0, int)
        for piece in range(n):
            asked = self._get(span, piece)["t"].to_numpy()
            times = np.union1d(times, asked[asked < until])
        fills, at = [], 0 if before is None else int(np.searchsorted(times, before + self._ttl))
        while at < len(times):
            fills.append(int(times[at]))
            at = int(np.searchsorted(times, times[at] + self._ttl))
        return fills

    def _answered(self, key: str, due: pd.DataFrame, known: np.ndarray) -> pd.DataFrame:
        times = due["t"].to_numpy()
        filled_at = known[np.searchsorted(known, times, side="right") - 1]
        # Requests at the instant of a fill are fills as well, as in the batch form.
        status = np.where(times == filled_at, "fill", "hit")
        return pd.DataFrame({"request_id": due["id"].to_numpy(), "k": key, "t": times, "status": status, "filled_at": filled_at})

    def close(self) -> None:
        pass


def stream_exact_cache(stream: DataFrame, key: str = "prompt_hash", ts: str = "ts",
                       ttl_s: int = cfg.CACHE_TTL_S, late: str = "10 minutes") -> DataFrame:
    """(request_id, key, ts, status, filled_at), needs the RocksDB state store.

    Entries expire by the requests' own times; hits do not prolong them.  Requests
    may come in any order within ``late``; a request is answered once the watermark
    has passed it.  State is dropped once it has passed the end of an entry.
    """
    at = F.col(ts).cast("timestamp")
    rows = (
        stream.withColumn("at", at)
        .withWatermark("at", late)
        .select("request_id", F.col(key).alias("k"), F.unix_micros("at").alias("t"), "at")
    )
    kinds = rows.schema
    labelled = rows.groupBy("k").transformWithStateInPandas(
        _Fills(ttl_s),
        f"request_id string, k {kinds['k'].dataType.simpleString()}, t long, status string, filled_at long",
        "Append",
        "EventTime",
    )
    kind = stream.schema[ts].dataType.simpleString()
    return labelled.select(
        F.col("request_id").cast(kinds["request_id"].dataType).alias("request_id"),
        F.col("k").alias(key),
        F.timestamp_micros("t").cast(kind).alias(ts),
        "status",
        F.timestamp_micros("filled_at").cast(kind).alias("filled_at"),
    )


def replay_sink(out_path: str, state_path: str, key: str = "prompt_hash", ts: str = "ts",
                ttl_s: int = cfg.CACHE_TTL_S) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` form of the same, for streams with very busy keys.

    Every micro-batch (request_id, key, ts) is replayed as a batch, so one key's
    requests are spread over many tasks.  The fills still alive are carried from
    batch to batch in a table; a repeated batch starts from the same table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("request_id", key, ts)
        id_type = rows.schema["request_id"].dataType
        if batch_id == 0:
            before = rows.limit(0).select(key, F.col(ts).alias("fill"))
        else:
            before = batch.sparkSession.read.parquet(f"{state_path}/batch_id={batch_id - 1}")
        placed = rows.join(before, key, "left")
        # Not after the known fill: answered by the entry as it is.
        late = placed.filter(F.col(ts) <= F.col("fill")).select(
            "request_id", key, ts, F.lit("hit").alias("status"), F.col("fill").alias("filled_at")
        )
        later = placed.filter(F.col("fill").isNull() | (F.col(ts) > F.col("fill"))).drop("fill")
        carried = before.select(
            F.lit(None).cast(id_type).alias("request_id"), key, F.col("fill").alias(ts)
        )
        # A carried fill is the first row of its key, so the chain goes on from it.
        replayed = cache_replay(later.unionByName(carried), key, ts, ttl_s)
        write_batch(
            replayed.filter(F.col("request_id").isNotNull()).unionByName(late), out_path, batch_id
        )
        done = batch.sparkSession.read.parquet(f"{out_path}/batch_id={batch_id}")
        known = before.unionByName(done.select(key, F.col("filled_at").alias("fill")))
        newest = done.agg(F.max(ts)).scalar()
        alive = F.col("fill") + seconds(ttl_s) > F.coalesce(newest, F.col("fill"))
        write_batch(
            known.groupBy(key).agg(F.max("fill").alias("fill")).filter(alive), state_path, batch_id
        )

    return write
