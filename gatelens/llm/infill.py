"""Fill-in-the-middle texts: two cuts per document, the middle part moved to the end.

A batch of texts is one array of bytes.  One scan finds where tokens end, and with
them the cuts.  Every part of a text moves as a whole, so each byte has a shift; the
shifts are written as differences at the starts of the parts, their cumulative sum is
the shift of each byte, and one scatter builds all outputs of the batch.  The way back
reads only output and form: marks are found in the output, the same differences say
from where each restored byte comes, and one gather restores the texts.

Cuts and forms follow from a hash of the doc_id, so they are the same in every run and
on every partitioning; nothing is shuffled.  A batch is worked on in slices of bytes,
and the sums over a slice in blocks, so a very long text needs little more than its
own size.

Rows: a null text counts as empty.  An empty text, or one that holds a mark, stays
plain.  A null doc_id hashes like an empty id; rows with one doc_id get the same draws.
A column that has the result's name already is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gatelens.llm.common import with_struct

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
PERCENT = 50  # of texts that are cut
SPM_PERCENT = 80  # of those, with the suffix first
SLICE_BYTES = 8 << 20  # of texts worked on at a time, at least one text
BLOCK_BYTES = 1 << 20  # of bytes moved at a time
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MARK = len(PREFIX)
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts; offsets count from the run's first byte."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _shifts(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, shift of every place) block by block, of parts that begin at ``starts``.

    Parts stand in order and cover all places; empty ones may share a start.
    """
    steps, carry = np.diff(shifts, prepend=0), 0
    for low in range(0, size, BLOCK_BYTES):
        high = min(low + BLOCK_BYTES, size)
        a, b = np.searchsorted(starts, [low, high])
        steps_here = np.zeros(high - low, np.int64)
        np.add.at(steps_here, starts[a:b] - low, steps[a:b])
        total = np.cumsum(steps_here) + carry
        carry = int(total[-1])
        yield low, total


def _token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Last bytes of tokens: words with the white space before them, and white space at the end of a text."""
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    space = _SPACE[data]
    closed = last.copy()
    closed[:-1] |= space[1:]
    return np.nonzero(np.where(space, last, closed))[0]


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks, and the rows they are in."""
    if len(data) < _MARK:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letters = np.isin(data[1:-1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])
    at = np.nonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & letters)[0]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + _MARK <= offsets[row + 1]
    return at[inside], row[inside]


def _draws(doc_ids: list) -> np.ndarray:
    """Four numbers below 2**32 of every doc_id."""
    digests = [hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def infilled(docs: DataFrame, result: str = "infill") -> DataFrame:
    """All documents with a struct ``result``: token count, form, sizes of the parts in code points, output."""

    def cut(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> list:
        ends = _token_ends(data, offsets)
        upto = np.searchsorted(ends, offsets)
        n = np.diff(upto)
        picks = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
        plain = (draws[:, 2] % 100 >= PERCENT) | (np.diff(offsets) == 0)
        plain[_marks(data, offsets)[1]] = True
        behind = np.append(ends + 1, 0)  # places behind tokens; the added one is never chosen
        cuts = np.where(picks == 0, offsets[:-1, None], behind[np.maximum(upto[:-1, None] + picks - 1, 0)])
        bounds = np.column_stack([offsets[:-1], cuts, offsets[1:]])
        spm = ~plain & (draws[:, 3] % 100 < SPM_PERCENT)
        prefix, middle, suffix = np.diff(bounds, axis=1).T
        size = np.diff(offsets) + np.where(plain, 0, 3 * _MARK)
        out_offsets = np.concatenate([[0], np.cumsum(size)])
        own = out_offsets[:-1]
        to_prefix = own + np.where(plain, 0, np.where(spm, 2 * _MARK + suffix, _MARK))
        to_middle = np.where(plain, to_prefix + prefix, own + 3 * _MARK + prefix + suffix)
        to_suffix = np.where(plain, to_middle + middle, own + np.where(spm, _MARK, 2 * _MARK + prefix))
        out = np.empty(int(out_offsets[-1]), np.uint8)
        shifts = (np.column_stack([to_prefix, to_middle, to_suffix]) - bounds[:, :3]).ravel()
        for low, shift in _shifts(bounds[:, :3].ravel(), shifts, len(data)):
            out[np.arange(low, low + len(shift)) + shift] = data[low : low + len(shift)]
        moved = ~plain
        for mark, place in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
            out[(place[moved] - _MARK)[:, None] + np.arange(_MARK)] = np.frombuffer(mark, np.uint8)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        sizes = np.diff(chars[bounds], axis=1)
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        return [
            pa.array(n),
            pa.array(form.tolist(), pa.large_string()),
            pa.array(sizes[:, 0], mask=plain),
            pa.array(sizes[:, 1], mask=plain),
            _strings(out, out_offsets),
        ]

    def run(batch: pa.RecordBatch) -> list:
        draws = _draws(batch.column(batch.schema.get_field_index("doc_id")).to_pylist())
        texts = batch.column(batch.schema.get_field_index("text"))
        parts = [cut(data, at, draws[i : i + len(at) - 1]) for i, data, at in _slices(texts)]
        return [pa.concat_arrays(c) for c in zip(*parts, strict=True)]

    return with_struct(docs, result, FIELDS, run)


def restored(texts: DataFrame, output: str = "output", form: str = "form", result: str = "restored") -> DataFrame:
    """All rows with a struct ``result`` that holds ``text``, rebuilt from the columns ``output`` and ``form``.

    It is null where the output does not hold the marks its form asks for, in their order.
    """

    def rebuild(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray) -> pa.Array:
        rows = len(forms)
        at, row = _marks(data, offsets)
        three = np.bincount(row, minlength=rows) == 3
        keep = three[row] & (forms != "plain")[row]
        places, marked = at[keep].reshape(-1, 3), row[keep][::3]
        order = np.where((forms == "spm")[marked, None], np.frombuffer(b"SPM", np.uint8), np.frombuffer(b"PSM", np.uint8))
        right = (data[places + 1] == order).all(axis=1) & (places[:, 0] == offsets[marked])
        right &= np.isin(forms[marked], ["spm", "psm"])
        places, marked = places[right], marked[right]
        whole = forms == "plain"
        # Where prefix, middle and suffix stand in the output; a plain text is all prefix.
        start = np.repeat(offsets[:-1, None], 3, axis=1)
        size = np.zeros((rows, 3), np.int64)
        size[whole, 0] = np.diff(offsets)[whole]
        first, second, third = (places + _MARK).T
        one, two = places[:, 1] - first, places[:, 2] - second
        spm = forms[marked] == "spm"
        start[marked] = np.column_stack([np.where(spm, second, first), third, np.where(spm, first, second)])
        size[marked] = np.column_stack([np.where(spm, two, one), offsets[marked + 1] - third, np.where(spm, one, two)])
        places_to = np.concatenate([[0], np.cumsum(size.ravel())])
        out = np.empty(int(places_to[-1]), np.uint8)
        for low, shift in _shifts(places_to[:-1], start.ravel() - places_to[:-1], len(out)):
            out[low : low + len(shift)] = data[np.arange(low, low + len(shift)) + shift]
        known = whole.copy()
        known[marked] = True
        text = _strings(out, np.append(places_to[:-1:3], places_to[-1]))
        return text if known.all() else pc.if_else(pa.array(known), text, None)

    def run(batch: pa.RecordBatch) -> list:
        forms = np.array([f or "" for f in batch.column(batch.schema.get_field_index(form)).to_pylist()], object)
        texts = batch.column(batch.schema.get_field_index(output))
        return [pa.concat_arrays([rebuild(data, at, forms[i : i + len(at) - 1]) for i, data, at in _slices(texts)])]

    return with_struct(texts, result, "text string", run)
