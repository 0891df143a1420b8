"""Graded quality by ordinal regression: one set of hashed-text weights, ordered thresholds.

With weights w, features x and thresholds t1 < t2 < ..., a document's grade is at
least k with probability sigmoid(w.x - tk).  Features are hashed: the words, the
shapes of the tokens (runs of capitals, letters and digits, marks as they are) and
repeats of the previous word, each family at unit length, with square roots of
counts.  The model is fitted on the driver to the features of a bounded sample of
ratings; scoring is one pass over the documents.

Rows: a null or empty text has no features; its grades follow from the thresholds.
Ratings without an id or grade are left out, of several for one id the lowest
counts, and of several documents with one id the text with the least hash.  With fewer than two grades among the ratings all documents get that grade.
"""

from __future__ import annotations

import operator
from collections import Counter
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import lower_words, utf8, with_struct

MAX_EXAMPLES = 8_000  # ratings to learn from, about
BUCKETS = 1 << 15
RIDGE = 0.3
STEPS = 200
KEEP = 0.5
_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)


def shapes(text: bytes) -> list[bytes]:
    """Tokens with their runs of one kind of character cut to one."""
    kinds = np.frombuffer(text.translate(_SHAPE), np.uint8)
    if not len(kinds):
        return []
    first = np.ones(len(kinds), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    return kinds[first].tobytes().split()


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, each once, and values."""
    data = utf8(text)
    words = lower_words(text)
    if not words:
        return np.empty(0, np.int32), np.empty(0)
    repeats = sum(map(operator.eq, words, islice(words, 1, None)))
    form = Counter(shapes(data))
    families = [
        np.unique(np.fromiter(map(crc32, words), np.uint32, len(words)) % buckets, return_counts=True),
        (
            np.array([crc32(b"\0shape " + s) % buckets for s in form], np.uint32),
            np.fromiter(form.values(), np.int64, len(form)),
        ),
        (np.array([crc32(b"\0again") % buckets, crc32(b"\0anew") % buckets]), np.array([repeats, len(words) - repeats])),
    ]
    at, value = [], []
    for numbers, counts in families:
        size = np.sqrt(counts)
        at.append(numbers)
        value.append(size / np.sqrt(counts.sum()))
    numbers, place = np.unique(np.concatenate(at), return_inverse=True)
    return numbers.astype(np.int32), np.bincount(place, np.concatenate(value))


class Model:
    """Weights, thresholds in ascending order, and the grades that they part."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[float]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, text: str | None) -> np.ndarray:
        """Probability of each grade but the lowest, or of a better one."""
        numbers, values = features(text, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(self.weights[numbers] @ values - self.thresholds, -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, buckets: int = BUCKETS) -> Model:
    """Cumulative logits by full gradient steps with momentum; ridge on the weights."""
    kinds, y = np.unique(grades, return_inverse=True)
    k = len(kinds)
    if k < 2:
        return Model(np.zeros(buckets), np.empty(0), kinds.tolist() or [0.0])
    starts = np.cumsum([0, *[len(n) for n, _ in rows]])
    numbers, values = np.concatenate([n for n, _ in rows]), np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), np.diff(starts))
    shares = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
    first = np.log(shares / (1 - shares))
    # The first threshold, and logarithms of the gaps between them, which keeps their order.
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    w, at, moment, square = np.zeros(buckets), free, np.zeros(buckets + k - 1), np.zeros(buckets + k - 1)
    for step in range(1, STEPS + 1):
        t = np.cumsum(np.concatenate([at[:1], np.exp(at[1:])]))
        eta = np.bincount(owner, values * w[numbers], minlength=len(rows))
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        high, low = cdf(edge[y + 1] - eta), cdf(edge[y] - eta)
        share = np.maximum(high - low, 1e-12)
        d_eta = high + low - 1  # of the log likelihood
        d_t = np.bincount(y, high * (1 - high) / share, minlength=k)[:-1] - np.bincount(y, low * (1 - low) / share, minlength=k)[1:]
        d_w = np.bincount(numbers, values * d_eta[owner], minlength=buckets) - RIDGE * w
        d_free = np.cumsum(d_t[::-1])[::-1] * np.concatenate([[1.0], np.exp(at[1:])])
        gradient = np.concatenate([d_w, d_free]) / len(rows)
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, at = w + move[:buckets], at + move[buckets:]
    return Model(w, np.cumsum(np.concatenate([at[:1], np.exp(at[1:])])), kinds.tolist())


def fit(docs: DataFrame, ratings: DataFrame, most: int = MAX_EXAMPLES, buckets: int = BUCKETS) -> Model:
    """A model from ``ratings`` (doc_id, grade), of which about ``most`` are used, by a hash of the id."""
    own = ratings.select(F.col("doc_id").alias("__id"), F.col("grade").cast("double").alias("grade")).dropna()
    own = own.groupBy("__id").agg(F.min("grade").alias("grade"))
    share = min(1.0, most / max(1, own.count()))
    picked = own.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounded by ``most``, so it is sent to the documents, which stay where they are.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))

    def run(batch: pa.RecordBatch) -> list:
        found = [features(t, buckets) for t in batch.column(0).to_pylist()]
        return [[n.tolist() for n, _ in found], [v.tolist() for _, v in found]]

    # One row per rating: an id may be on any number of documents.
    one = F.min_by(F.struct("text", "grade"), F.xxhash64("text")).alias("e")
    single = joined.groupBy("__id").agg(one).select("e.*")
    rows = with_struct(single, "x", "numbers array<int>, values array<float>", run)
    table = rows.select("grade", "x.*").toArrow().combine_chunks()  # bounded by ``most``
    numbers, values = (_parts(table.column(c)) for c in ("numbers", "values"))
    grades = table.column("grade").to_numpy()
    # Sums do not depend on how the rows arrive.
    order = sorted(range(len(grades)), key=lambda i: (grades[i], numbers[i].tobytes(), values[i].tobytes()))
    return fit_ordinal([(numbers[i], values[i]) for i in order], grades[order], buckets)


def _parts(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as slices of one array."""
    lists = [chunk for chunk in column.chunks if len(chunk)]
    return [part for c in lists for part in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])]


def graded(docs: DataFrame, model: Model, result: str = "quality") -> DataFrame:
    """All documents with a struct ``result``: expected grade and the tail probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``buckets`` numbers

    def run(batch: pa.RecordBatch) -> list:
        own = shared.value
        gaps = np.diff(own.grades)
        tails = [own.tails(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        return [[own.grades[0] + float(t @ gaps) for t in tails], [t.tolist() for t in tails]]

    return with_struct(docs, result, "grade double, tails array<double>", run)


def label_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels: 0 for junk, 1 for good but toxic text, 2 for good text."""
    good, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.select("doc_id", F.when(good == 0, 0).when(good == 1, F.when(toxic == 1, 1).otherwise(2)).alias("grade"))


def accepted(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents, unchanged, that are more likely than ``keep`` to be better than the lowest grade."""
    found = graded(docs, fit(docs, label_grades(labels)), "__quality")
    tail = F.coalesce(F.try_element_at("__quality.tails", F.lit(1)), F.lit(1.0))
    return found.filter(tail >= keep).select(*docs.columns)
