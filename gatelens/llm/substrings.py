"""Substring deduplication: equal passages of at least ``min_run`` bytes, found by content-defined chunks.

A gear hash rolls over a text's bytes.  Of every ``SPREAD`` places in a row the one
with the least hash is a cut, so cuts depend on nearby bytes only and an insertion moves
no others.  The chunk between two neighbouring cuts, with the bytes that its first cut
depends on, is digested; any two equal passages of 2 * SPREAD + 15 bytes hold a whole
chunk at the same place.  Chunks with equal 128-bit digests are copies, called seeds
below; the first in order of doc_id and place stays.  Seeds that
overlap alike in both texts are one match; it is extended to both sides as far as
the first text's neighbouring bytes are equal, less than ``SPREAD`` on either side
where the first text holds the whole passage.  Matches of ``min_run`` bytes are
removed, so that short phrases that many texts share stay.  Where one digest repeats
within a text, as in short periods, few of its chunks are seeds; extension covers the rest.

First only 64 bits of each digest are counted, which finds the few seeds that
occur twice; only these go on.  Frequent seeds collapse before that shuffle, and
joins on them are with one row per digest, so large groups are split.  Of the first
texts only the bytes beside the ends of matches are sent, once per place.

Rows: null texts stay null and have no seeds.  Rows that share doc_id and text are
one document and keep the same; a null doc_id comes after all others.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import map_rows, utf8, with_struct, written

SPREAD = 64  # places in a row of which one is a cut
WINDOW = 16  # bytes a hash depends on
LEAST = 2 * SPREAD + WINDOW - 1  # bytes of a passage that hold a chunk
MIN_RUN = 150  # bytes, at least LEAST
CONTEXT = 192  # bytes beside a match, more than a chunk as seeds near its ends may have other first texts
_GEAR = np.array([random.Random(b).getrandbits(16) for b in range(256)], np.uint16)


def _rolled(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes up to each place."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):  # now of the last 2, 4, 8, 16 bytes
        h[step:] += h[:-step] << np.uint16(step)
    return h


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, stop) of the chunks between neighbouring cuts, each with the bytes its first cut depends on."""
    if len(data) < LEAST:
        return []
    h = _rolled(np.frombuffer(data, np.uint8))[WINDOW - 1 :].astype(np.int64)
    least, size = (h << 40) + np.arange(len(h)), 1  # the first of equal hashes
    while size < SPREAD:
        step = min(size, SPREAD - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    cuts = np.unique(least & ((1 << 40) - 1)).tolist()
    return [(a, b + WINDOW) for a, b in itertools.pairwise(cuts)]


def seeds(data: bytes) -> tuple[list[int], list[int], list[bytes]]:
    """Starts, sizes and digests of the chunks of a text."""
    starts: list[int] = []
    sizes: list[int] = []
    digests: list[bytes] = []
    for start, stop in chunks(data):
        digest = xxhash.xxh3_128_digest(data[start:stop])
        # Of a short period the first two, which tell its length, and then few.
        if digests[-2:] != [digest, digest] or start - starts[-1] >= SPREAD // 2:
            starts.append(start)
            sizes.append(stop - start)
            digests.append(digest)
    return starts, sizes, digests


def seed_table(docs: DataFrame) -> DataFrame:
    """(doc_id, version, high, low, start, size): one row per seed; ``version`` tells texts with one doc_id apart."""

    def run(batch: pa.RecordBatch) -> list:
        rows, digests, starts, sizes = [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            own, long, of = seeds(utf8(text))
            rows += [row] * len(own)
            starts += own
            sizes += long
            digests += of
        parts = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int32())
        return [batch.column(0).take(at), batch.column(1).take(at), pa.array(parts[:, 0]), pa.array(parts[:, 1]), starts, sizes]

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    return map_rows(keyed, run, f"doc_id {kind}, version long, high long, low long, start int, size int")


def copied_seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, size, first): seeds that occur earlier, and where: (unnamed, doc_id, version, start)."""
    every = seed_table(docs)
    often = every.groupBy("high").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("high")
    again = written(every.join(written(often, "often"), "high"), "seeds-again")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "start")
    first = again.groupBy("high", "low").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("n > 1").select("high", "low", "first"), "first-seeds")
    return (
        again.join(first, ["high", "low"])
        .filter(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "version", "start", "size", "first")
    )


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, stop, first_doc, first_version, side, place): both ends of every match of seeds.

    ``place`` is where the end at ``side`` (0 before, 1 behind) lies in the first text.
    """
    shift = (F.col("start") - F.col("first.start")).alias("shift")
    alike = F.struct("first.doc_id", "first.version", shift, "start", "size")
    of = copied_seeds(docs).groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(alike)).alias("seeds"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list:
        rows, out = [], []
        for row, own in enumerate(batch.column(2).to_pylist()):
            joined: list[list] = []
            for s in own:
                key = (s["doc_id"], s["version"], s["shift"])
                stop = s["start"] + s["size"]
                if joined and joined[-1][2] == key and s["start"] <= joined[-1][1]:
                    joined[-1][1] = max(stop, joined[-1][1])
                else:
                    joined.append([s["start"], stop, key])
            for start, stop, (doc, version, by) in joined:
                rows += [row, row]
                out += [(start, stop, doc, version, 0, start - by), (start, stop, doc, version, 1, stop - by)]
        at = pa.array(rows, pa.int32())
        return [batch.column(0).take(at), batch.column(1).take(at), *[[r[k] for r in out] for k in range(6)]]

    fields = f"start int, stop int, first_doc {kind}, first_version long, side int, place int"
    return map_rows(of, run, f"doc_id {kind}, version long, {fields}")


def copied_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, __spans): matches of each text, with the first text's bytes beside them."""
    ends = written(matches(docs), "match-ends")
    key = ["first_doc", "first_version", "side", "place"]
    texts = docs.select(
        F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__of"), F.encode("text", "UTF-8").alias("bytes")
    )
    same = F.col("first_doc").eqNullSafe(F.col("__id")) & (F.col("first_version") == F.col("__of"))
    start = F.when(F.col("side") == 0, F.greatest(F.col("place") - CONTEXT, F.lit(0))).otherwise(F.col("place"))
    size = F.when(F.col("side") == 0, F.least("place", F.lit(CONTEXT))).otherwise(F.lit(CONTEXT))
    beside = ends.select(key).distinct().join(texts, same).select(*key, F.substring("bytes", start + 1, size).alias("beside"))
    # Rows with one doc_id and text have the same bytes.
    beside = written(beside, "beside-rows").groupBy(*key).agg(F.min("beside").alias("beside"))
    beside = written(beside, "beside").withColumnsRenamed({k: f"__{k}" for k in key})
    alike = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return ends.join(beside, alike).groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop", "first_doc", "first_version", "place", "side", "beside"))).alias("__spans")
    )


def _common(a: bytes, b: bytes) -> int:
    """Leading bytes that are equal."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n) if n else np.empty(0, bool)
    return int(differ.argmax()) if differ.any() else n


def _runs(data: bytes, spans: list[dict], min_run: int) -> list[tuple[int, int, set]]:
    """Extended matches of at least ``min_run`` bytes, joined where they meet, with the documents that had them first."""
    full: dict[tuple, list[int]] = {}
    for p in spans:
        start, stop = p["start"], p["stop"]
        shift = p["place"] - (stop if p["side"] else start)
        own = full.setdefault((start, stop, p["first_doc"], p["first_version"], shift), [start, stop])
        if p["side"]:
            own[1] += _common(data[stop : stop + CONTEXT], p["beside"])
        else:
            own[0] -= _common(data[max(0, start - CONTEXT) : start][::-1], p["beside"][::-1])
    runs: list[tuple[int, int, set]] = []
    long = [(a, -b, (doc is None, "" if doc is None else doc)) for (_, _, doc, *_), (a, b) in full.items() if b - a >= min_run]
    upto, holder = -1, None
    for start, negative, order in sorted(long):
        stop, doc = -negative, None if order[0] else order[1]
        if stop <= upto and holder <= order:  # an earlier document has all of it
            continue
        if stop >= upto:
            upto, holder = stop, order
        while start < stop and data[start] & 0xC0 == 0x80:  # characters stay whole
            start += 1
        while start < stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]), runs[-1][2] | {doc})
        else:
            runs.append((start, stop, {doc}))
    return runs


def without_copies(docs: DataFrame, min_run: int = MIN_RUN, result: str = "copies") -> DataFrame:
    """All documents with copied passages cut out of ``text``, and a struct ``result``.

    It holds ``starts`` and ``stops`` (code points of the old text) of what was cut,
    ``removed`` (their total) and ``first_docs``, the documents that keep it.
    """
    if min_run < LEAST:
        raise ValueError(f"passages below {LEAST} bytes need not hold a chunk")
    spans = copied_spans(docs)
    keyed = docs.withColumn("__version", F.xxhash64("text")).alias("d")
    s = written(spans, "copied-spans").withColumnsRenamed({"doc_id": "__id", "version": "__of"}).alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.__id")) & (F.col("d.__version") == F.col("s.__of"))
    joined = keyed.join(s, same, "left").drop("__id", "__of", "__version")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"text string, starts array<int>, stops array<int>, removed int, first_docs array<{kind}>"

    def run(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(5)]
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
        for text, spans in zip(texts, found, strict=True):
            kept, starts, stops, cut, docs_of = text, [], [], 0, set()
            if spans and (runs := _runs(data := utf8(text), spans, min_run)):
                done, parts, chars = 0, [], 0
                for start, stop, of in runs:
                    before, inside = data[done:start].decode(), data[start:stop].decode()
                    parts.append(before)
                    starts.append(chars + len(before))
                    chars += len(before) + len(inside)
                    stops.append(chars)
                    cut += len(inside)
                    done = stop
                    docs_of |= of
                kept = "".join([*parts, data[done:].decode()])
            for column, value in zip(out, (kept, starts, stops, cut, sorted(docs_of - {None})), strict=True):
                column.append(value)
        return out

    cut = with_struct(joined, "__cut", fields, run)
    parts = F.struct(*[F.col(f"__cut.{n}") for n in ("starts", "stops", "removed", "first_docs")])
    names = [c for c in docs.columns if c != result]
    return cut.withColumn("text", F.col("__cut.text")).withColumn(result, parts).select(*names, result)
