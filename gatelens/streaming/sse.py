"""Assembling streamed answers while their lines arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatelens.functions.once import compute_once
from gatelens.functions.sse import DONE, sse_delta
from gatelens.operators.streams import stream_records

IDLE_MS = 120_000
KEEP_MS = 3_600_000  # how long a finished stream is remembered


class _Parts(StatefulProcessor):
    """The deltas seen so far, until the stream is over.

    After a DONE line a stream waits for the watermark to pass its newest line, so
    that lines which were overtaken still count; without one it waits for a pause.
    A finished stream is remembered for a while and swallows what still comes.

    Every call of the state is a message to the JVM and back, so all that is known
    of a stream, its one timer too, is a single value.
    """

    _NEW = {"done": False, "closed": False, "newest": 0, "timer": None, "seqs": [], "deltas": []}
    _SCHEMA = "done boolean, closed boolean, newest long, timer long, seqs array<long>, deltas array<string>"

    def __init__(self, idle_ms: int, keep_ms: int):
        self._idle, self._keep = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", self._SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._load() or self._fresh()
        self._add(known, rows)
        if not known["closed"]:
            self._save(known)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._load()
        if known["closed"]:
            self._state.clear()
            return
        text = self._close(known, expiredTimerInfo)
        self._save(known)
        if text is not None:
            yield Row(stream_id=key[0], text=text)

    def _add(self, known: dict, lines: Iterator[Row]) -> None:
        """Lines that come; a closed stream only reads them."""
        for line in lines:
            if known["closed"]:
                continue
            known["done"] = known["done"] or bool(line["done"])
            if line["at_ms"] is not None:
                known["newest"] = max(known["newest"], line["at_ms"])
            if line["delta"] is not None:
                known["seqs"].append(line["seq"])
                known["deltas"].append(line["delta"])
        if not known["closed"]:
            self._wait(known, known["newest"] + (1 if known["done"] else self._idle))

    def _close(self, known: dict, expired) -> str | None:
        """The text of a stream that is over, if it has any."""
        parts = sorted(zip(known["seqs"], known["deltas"], strict=True))
        known.update(done=True, closed=True, timer=None, seqs=[], deltas=[])  # Spark deletes a timer that went off
        self._wait(known, expired.getExpiryTimeInMs() + self._keep)
        return "".join(delta for _, delta in parts) if parts else None

    def _wait(self, known: dict, until: int) -> None:
        if known["timer"] != until:
            if known["timer"] is not None:
                self._handle.deleteTimer(known["timer"])
            self._handle.registerTimer(until)
            known["timer"] = until

    def _fresh(self) -> dict:
        return {k: list(v) if isinstance(v, list) else v for k, v in self._NEW.items()}

    def _load(self) -> dict | None:
        values = self._state.get()
        known = None if values is None else dict(zip(self._NEW, values, strict=True))
        return known and known | {k: list(known[k]) for k in ("seqs", "deltas")}

    def _save(self, known: dict) -> None:
        self._state.update(tuple(known[k] for k in self._NEW))

    def close(self) -> None:
        pass


class _Records(_Parts):
    """The same, with the request that the answer belongs to; it may come before, during or after the answer."""

    _ASKED = ("prompt", "model", "strategy", "latency_ms")
    _NEW = _Parts._NEW | {"asked": False} | dict.fromkeys(_ASKED) | {"text": None}
    _SCHEMA = _Parts._SCHEMA + ", asked boolean, prompt string, model string, strategy string, latency_ms long, text string"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._load()
        known, lines = before or self._fresh(), []
        for row in rows:
            if row["model"] is not None:
                known.update({c: row[c] for c in self._ASKED}, asked=True)
            else:
                lines.append(row)
        if lines:
            self._add(known, iter(lines))
        elif before is None:  # a request whose answer never comes is forgotten
            known["newest"] = timerValues.getCurrentWatermarkInMs()
            self._wait(known, known["newest"] + self._keep)
        yield from self._both(key, known)
        self._save(known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._load()
        if known["closed"]:
            self._state.clear()
            return
        known["text"] = self._close(known, expiredTimerInfo)
        yield from self._both(key, known)
        self._save(known)

    def _both(self, key, known: dict) -> Iterator[Row]:
        if known["text"] is not None and known["asked"]:
            row = Row(stream_id=key[0], text=known["text"], **{c: known[c] for c in self._ASKED})
            known.update(dict.fromkeys(self._ASKED), asked=False, text=None)
            yield row


def stream_completion_records(lines: DataFrame, requests: DataFrame, ts: str = "ts", idle_ms: int = IDLE_MS,
                              late: str = "1 minute", keep_ms: int = KEEP_MS,
                              price_table: DataFrame | None = None) -> DataFrame:
    """Log records of finished streams: answer lines (stream_id, seq, line, ts) with their requests.

    ``requests`` holds (stream_id, prompt, model, strategy, latency_ms, ts).  The two
    streams meet in one keyed state; either side waits up to ``keep_ms`` for the other.
    """
    null = lambda kind: F.lit(None).cast(kind)
    asked = ("prompt", "model", "strategy")
    left = _text_lines(lines, ts).select(
        "stream_id", "seq", "delta", "done", "at_ms", ts, *[null("string").alias(c) for c in asked], null("long").alias("latency_ms")
    )
    right = requests.select(
        "stream_id", null("long").alias("seq"), null("string").alias("delta"), F.lit(False).alias("done"),
        F.unix_millis(F.col(ts)).alias("at_ms"), ts, "prompt", F.coalesce("model", F.lit("")).alias("model"), "strategy",
        F.col("latency_ms").cast("long").alias("latency_ms"),
    )
    kind = lines.schema["stream_id"].dataType.simpleString()
    finished = left.unionByName(right).withWatermark(ts, late).groupBy("stream_id").transformWithState(
        _Records(idle_ms, keep_ms),
        f"stream_id {kind}, text string, prompt string, model string, strategy string, latency_ms long",
        "Append",
        "EventTime",
    )
    return stream_records(finished, price_table)


def _text_lines(lines: DataFrame, ts: str) -> DataFrame:
    """Text-bearing and final lines."""
    parsed = compute_once(lines, delta=sse_delta(F.col("line")))
    parts = parsed.select(
        "stream_id", "seq", "delta", (F.col("line") == DONE).alias("done"), F.unix_millis(F.col(ts)).alias("at_ms"), ts
    )
    return parts.filter(F.col("delta").isNotNull() | F.col("done"))


def stream_sse_assemble(lines: DataFrame, ts: str = "ts", idle_ms: int = IDLE_MS,
                        late: str = "1 minute", keep_ms: int = KEEP_MS) -> DataFrame:
    """(stream_id, seq, line, ts) -> (stream_id, text) of every finished stream.

    Only text-bearing and final lines reach the state; needs the RocksDB store.
    """
    parts = _text_lines(lines.withWatermark(ts, late), ts)
    kind = lines.schema["stream_id"].dataType.simpleString()
    return parts.groupBy("stream_id").transformWithState(
        _Parts(idle_ms, keep_ms), f"stream_id {kind}, text string", "Append", "EventTime"
    )
