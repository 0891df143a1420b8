"""Toxicity from a learned lexicon, found despite misspellings and weighed by context.

Terms are words, and stems that go on, which labelled rows show to be far more
frequent in toxic documents; each has to be too frequent there for chance among
all candidates.  The lexicon is a trie.  Words are matched against its
intersection with the automaton of one edit (an insertion, a deletion, a
replacement or a swap of neighbours), made deterministic as words need it.  Terms
that clean documents often hold with an edit are only matched as they are.
Around each hit a window of words tells quotation (marks around it, or words of
reporting) from abuse; sums over a document's hits go into a logistic regression.

Rows: a null or empty text has no hits and gets the score of that.  Repeated rows
are scored each.  Without labelled rows of both kinds all scores are the rate of
toxic ones.  Rows with a null label or id are no examples.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import with_struct, written

MAX_EXAMPLES = 20_000  # labelled rows to learn from, about
MAX_TERMS = 1_000
LEAST_TOXIC = 3  # documents that a term needs
LEAST_WEIGHT = 2.0  # in log odds
MOST_WEIGHT = 6.0
MOST_SUM = 20.0
EDITED_COUNTS = 0.7  # evidence of a term found with an edit, against one as it is
STEM_CHARS = range(4, 8)
EDIT_CHARS = 5  # shorter terms are matched as they are
EDITED_IN_CLEAN = 0.002  # share of clean documents up to which a term is matched with an edit
WINDOW = 8  # words on either side of a hit
THRESHOLD = 0.7
RIDGE = 0.1
CACHED_WORDS = 300_000
STATES = 100_000
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“„«‹‟”", "\"”“»›‟"
_REPORT = frozenset(
    "said says wrote writes quoted quote quotes reported called calls word term dit écrit cite sagte schrieb zitiert nannte "
    "dijo escribió cita llamó".split()
)
_ADDRESS = frozenset("you your youre du dich dir ihr tu te toi vous usted ustedes eres".split())


class Automaton:
    """The lexicon trie intersected with the automaton of at most one edit.

    A state is a set of (node, edits, awaited character); a swap awaits the second
    of the two characters.  ``match`` gives (term number, edits) or None.
    """

    def __init__(self, terms: list[tuple[str, bool, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool, bool] | None] = [None]
        for number, (text, stem, edits) in enumerate(terms):
            node = 0
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            if self.ends[node] is None or stem:
                self.ends[node] = (number, stem, edits)
        self._fresh()

    def _fresh(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []  # at the end of a word
        self.stems: list[tuple[int, int] | None] = []  # whatever follows
        self._number(frozenset(self._with_deletions({(0, 0, "")})))

    def _with_deletions(self, state: set) -> set:
        return state | {(child, 1, "") for node, e, wait in state if not e and not wait for child in self.children[node].values()}

    def _number(self, state: frozenset) -> int:
        if state in self.numbers:
            return self.numbers[state]
        number = self.numbers[state] = len(self.states)
        word = stem = None
        for node, e, wait in state:
            end = None if wait else self.ends[node]
            if end and (not e or end[2]):
                word = min(filter(None, (word, (e, end[0]))))
                stem = min(filter(None, (stem, (e, end[0])))) if end[1] else stem
        self.states.append(state)
        self.steps.append({})
        self.accepts.append(word)
        self.stems.append(stem)
        return number

    def _step(self, at: int, c: str) -> int:
        found = set()
        for node, e, wait in self.states[at]:
            if wait:
                if c == wait:
                    found.add((node, e, ""))
                continue
            own = self.children[node]
            if c in own:
                found.add((own[c], e, ""))
            if not e:
                found.add((node, 1, ""))
                for x, child in own.items():
                    found.add((child, 1, ""))
                    if c in self.children[child]:
                        found.add((self.children[child][c], 1, x))
        found = self._with_deletions(found)
        exact = {(node, wait) for node, e, wait in found if not e}
        number = self._number(frozenset(s for s in found if not s[1] or (s[0], s[2]) not in exact))
        self.steps[at][c] = number
        return number

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.states) > STATES:
            self._fresh()
        at, stem = 0, None
        for c in word:
            known = self.steps[at]
            at = known[c] if c in known else self._step(at, c)
            if self.stems[at] is not None and (stem is None or self.stems[at] < stem):
                stem = self.stems[at]
            if not self.states[at]:
                break
        best = min(filter(None, (stem, self.accepts[at])), default=None)
        return None if best is None else (best[1], best[0])


class _Matches(dict):
    """Word -> match, remembered for the words of a task."""

    def __init__(self, terms: list[tuple[str, bool, bool]]):
        super().__init__()
        self.automaton = Automaton(terms)

    def __missing__(self, word: str):
        found = self.automaton.match(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


def hits_of(text: str, matches) -> tuple[int, list[tuple[int, int, bool, bool]]]:
    """Number of words, and per hit (term, edits, quoted, addressed)."""
    low = text.lower()
    words = _WORD.findall(low)
    found = [(i, m) for i, m in enumerate(map(matches.__getitem__, words)) if m is not None]
    if not found:
        return len(words), []
    spans = [m.span() for m in _WORD.finditer(low)]
    hits = []
    for i, (term, edits) in found:
        first, last = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        start = spans[first - 1][1] if first else 0
        before, after = low[start : spans[i][0]], low[spans[i][1] : spans[last - 1][1] + 2]
        near = words[first:last]
        marks = _opened(before) and any(c in _CLOSE for c in after)
        hits.append((term, edits, marks or not _REPORT.isdisjoint(near), not _ADDRESS.isdisjoint(near)))
    return len(words), hits


def _opened(before: str) -> bool:
    """Whether a quotation that begins in ``before`` is still open at its end."""
    opened = False
    for c in before:
        if opened and c in _CLOSE:
            opened = False
        elif c in _OPEN:
            opened = True
    return opened


def features(n_words: int, hits: list[tuple[int, int, bool, bool]], weights: list[float]) -> list[float]:
    """What the regression sees of a document; quotations have one feature of their own."""
    plain = [h for h in hits if not h[2]]
    exact = {t for t, e, _, _ in plain if not e}
    edited = {t for t, e, _, _ in plain if e} - exact
    quoted = {t for t, _, q, _ in hits if q} - exact - edited
    evidence = sum(weights[t] for t in exact) + EDITED_COUNTS * sum(weights[t] for t in edited)
    return [
        min(MOST_SUM, evidence),
        math.log1p(len(plain)),
        math.log1p(100 * len(plain) / max(n_words, 1)),
        min(MOST_SUM, sum(weights[t] for t in quoted)),
        float(any(addressed for *_, addressed in plain)),
    ]


N_FEATURES = 5
RISING = (0, 1, 2)  # more of these never lowers a score


def fold(doc_id: str):
    """The remainder that decides what a row is for."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def examples(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """(text, toxic) of about ``most`` labelled rows at most, of those not held out; by a hash of the id.

    Copies and near copies would count a document's words again and again, so of
    texts with the same least shingle hash one is an example.  An id may be on any
    number of documents; the text with the least hash stands for it.
    """
    own = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    own = own.filter(fold("__id") != 1).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(1, own.count()))
    picked = own.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounded by ``most``, so it is sent to the documents, which stay where they are.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))

    def key(batch: pa.RecordBatch) -> list:
        return [[_least_shingle(t or "") for t in batch.column(0).to_pylist()]]

    own_text = F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("e")
    single = joined.groupBy("__id").agg(own_text).select("e.*")
    keyed = with_struct(single, "__key", "least long", key)
    one = F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), F.col("toxic")))
    return written(keyed.groupBy("__key.least").agg(one.alias("e")).select("e.*"), "toxicity-examples")


def _least_shingle(text: str) -> int:
    """Least hash of five words in a row; near copies mostly share it."""
    words = _WORD.findall(text.lower())
    runs = zip(*(words[i:] for i in range(5)), strict=False) if len(words) >= 5 else [words]
    return min(xxhash.xxh64_intdigest(" ".join(r)) for r in runs) >> 1


def _candidate_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): documents that hold each word and each stem."""
    schema = "term string, stem boolean, toxic long, clean long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                own = {(w, False) for w in words}
                own.update((w[:n], True) for w in words for n in STEM_CHARS if len(w) > n)
                for key in own:
                    seen.setdefault(key, [0, 0])[0 if toxic else 1] += 1
        columns = [[k[0] for k in seen], [k[1] for k in seen], [n[0] for n in seen.values()], [n[1] for n in seen.values()]]
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["term", "stem", "toxic", "clean"]
        )

    return rows.mapInArrow(count, schema).groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(rows: DataFrame, most: int = MAX_TERMS) -> list[tuple[str, bool, float]]:
    """(text, is a stem, weight) of the terms that tell toxic examples from clean ones."""
    toxic, clean = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not toxic or not clean:
        return []
    counts = written(_candidate_counts(rows), "toxicity-candidates")
    rate = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    # Chernoff's bound for so many toxic documents among those that hold the term.
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    gain = part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    # Rarer candidates could not stand out at all, so they are no chances to be wrong.
    testable = counts.filter(n >= LEAST_TOXIC).count()
    chosen: list = []
    found = (
        counts.withColumn("gain", gain)
        .withColumn("weight", F.least(weight, F.lit(MOST_WEIGHT)))
        .filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("weight") >= LEAST_WEIGHT))
        .filter(F.col("gain") >= math.log(max(2, testable)))
        .orderBy(F.desc("gain"), F.desc(F.length("term")), "stem", "term")
        .limit(8 * most)
        .collect()
    )
    for r in found:
        covered = any(
            (c.stem and r.term.startswith(c.term)) or (r.stem and c.term.startswith(r.term) and r.toxic <= 1.1 * c.toxic)
            for c in chosen
        )
        if not covered and len(chosen) < most:
            chosen.append(r)
    return [(r.term, r.stem, float(r.weight)) for r in chosen]


class Model:
    """Terms, their weights, and the regression's coefficients with the constant first."""

    def __init__(self, terms: list[tuple[str, bool, bool]], weights: list[float], coefficients: np.ndarray):
        self.terms, self.weights, self.coefficients = terms, weights, coefficients

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = self.coefficients[0] + rows @ self.coefficients[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _document_features(rows: DataFrame, terms, weights, result: str = "__features") -> DataFrame:
    memory: dict[str, _Matches] = {}

    def run(batch: pa.RecordBatch) -> list:
        matches = memory.get("m") or memory.setdefault("m", _Matches(terms))
        out = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            n, hits = hits_of(text or "", matches)
            out.append(features(n, hits, weights))
        return [out]

    return with_struct(rows, result, "f array<double>", run)


def _edited_in_clean(rows: DataFrame, terms: list[tuple[str, bool, bool]]) -> dict[int, int]:
    """Clean examples in which each term occurs with an edit."""
    memory: dict[str, _Matches] = {}

    def run(batch: pa.RecordBatch) -> list:
        matches = memory.get("m") or memory.setdefault("m", _Matches(terms))
        out = []
        for text in batch.column(0).to_pylist():
            found = {m for m in map(matches.__getitem__, set(_WORD.findall((text or "").lower()))) if m}
            out.append([t for t, edits in found if edits])
        return [out]

    found = with_struct(rows.filter("toxic = 0").select("text"), "e", "terms array<int>", run)
    counted = found.select(F.explode("e.terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return {r.term: r.n for r in counted.collect()}


def _logistic(x: np.ndarray, y: np.ndarray, rising: tuple[int, ...] = ()) -> np.ndarray:
    """Coefficients with the constant first; ``rising`` columns get none below zero."""
    used = list(range(x.shape[1]))
    while True:
        b = _newton(x[:, used], y)
        wrong = [c for c, at in zip(b[1:], used, strict=True) if at in rising and c < 0]
        if not wrong:
            break
        used.pop(b[1:].tolist().index(min(wrong)))
    out = np.zeros(x.shape[1] + 1)
    out[[0, *[at + 1 for at in used]]] = b
    return out


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Logistic regression with a constant, which is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (y - p) - shrink * b
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(shrink), gradient)
        b += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> Model:
    """Lexicon and regression from a bounded number of labelled rows."""
    rows = examples(docs, labels, most)
    toxic, clean = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not toxic or not clean:
        constant = math.log((toxic + 0.5) / (clean + 0.5)) if toxic or clean else 0.0
        return Model([], [], np.array([constant, *[0.0] * N_FEATURES]))
    chosen = lexicon(rows)
    terms = [(t, stem, len(t) >= EDIT_CHARS) for t, stem, _ in chosen]
    edited = _edited_in_clean(rows, terms)
    terms = [(t, s, e and edited.get(i, 0) <= EDITED_IN_CLEAN * clean) for i, (t, s, e) in enumerate(terms)]
    weights = [w for _, _, w in chosen]
    table = _document_features(rows, terms, weights).select("__features.f", "toxic").toArrow()  # bounded by ``most``
    x = np.array(table.column(0).to_pylist(), float).reshape(-1, N_FEATURES)
    return Model(terms, weights, _logistic(x, table.column(1).to_numpy().astype(float), RISING))


def scored(docs: DataFrame, model: Model, result: str = "toxicity") -> DataFrame:
    """All documents with a struct ``result``: score, hits and quoted hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``MAX_TERMS`` terms
    memory: dict[str, _Matches] = {}

    def run(batch: pa.RecordBatch) -> list:
        own = shared.value
        matches = memory.get("m") or memory.setdefault("m", _Matches(own.terms))
        rows, n_hits, n_quoted = [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            n, hits = hits_of(text or "", matches)
            rows.append(features(n, hits, own.weights))
            n_hits.append(len(hits))
            n_quoted.append(sum(h[2] for h in hits))
        return [own.score(np.array(rows)), n_hits, n_quoted]

    return with_struct(docs, result, "score double, n_hits long, n_quoted long", run)
