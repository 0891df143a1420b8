"""Repair of conversation roles at least cost, and the chat text of the result.

Legal is one system turn at most, first, and then user and assistant in turns,
ending with the assistant.  Every turn may be kept, relabelled, merged with the turn
before, or get empty turns inserted before it; a dynamic program over the states of
the legal-turn automaton finds the cheapest repair.  The step of one turn is a
matrix of costs between states, and steps combine by (min, +), which is
associative: a conversation is cut into blocks, every block gives one matrix, the
matrices of a conversation are chained, and each block then repairs its turns
between its first and last state.  No task holds a whole conversation.

Rows: exact copies of a row count once.  Turns go by number, those without a number
last; equal numbers by role (system, user, assistant, others), then by a hash of the
text.  A null text is empty, a null or unknown role may become any role, a null
``conv_id`` is a conversation like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from gatelens.llm.common import map_rows, written

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, UNKNOWN, INSERT, MERGE = 3, 1, 2, 1  # costs
BLOCK_TURNS = 512
_FAR = 1 << 40


def role_class(role: str | None) -> int:
    """0 to 2 for the roles, 3 for all others."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def _options(state: int, own: int) -> Iterator[tuple[int, int, int, tuple[int, ...], bool]]:
    """(cost, next state, label, labels of turns inserted before, merged) of a turn of class ``own``."""
    for label in range(3):
        cost = 0 if label == own else UNKNOWN if own == 3 else RELABEL
        after = label + 1
        if state == after:
            yield cost + MERGE, after, label, (), True
        if label == 0:
            if state == START:
                yield cost, after, label, (), False
        elif label == 1:
            if state != USER:
                yield cost, after, label, (), False
            else:
                yield cost + INSERT, after, label, (2,), False
        elif state == USER:
            yield cost, after, label, (), False
        else:
            yield cost + INSERT, after, label, (1,), False


#: Cheapest option by class and pair of states; on a tie the first.
_BEST = {
    own: {
        (state, after): min((o for o in _options(state, own) if o[1] == after), key=lambda o: o[0])
        for state in range(4)
        for after in {o[1] for o in _options(state, own)}
    }
    for own in range(4)
}
#: Turns inserted at the end of a conversation.
_END = {START: (1, 2), SYSTEM: (1, 2), USER: (2,), ASSISTANT: ()}


def block_costs(classes: list[int]) -> list[int]:
    """Cost from each state to each state over a block, as 16 numbers."""
    out = []
    for first in range(4):
        cost = [_FAR] * 4
        cost[first] = 0
        for own in classes:
            new = [_FAR] * 4
            for (a, b), option in _BEST[own].items():
                new[b] = min(new[b], cost[a] + option[0])
            cost = new
        out += cost
    return out


def chain(matrices: list[list[int]]) -> tuple[int, list[int]]:
    """Total cost, and the state before each block and after the last, on the cheapest path."""
    cost, back = [0, _FAR, _FAR, _FAR], []
    for m in matrices:
        froms = [min(range(4), key=lambda a, b=b: (cost[a] + m[4 * a + b], a)) for b in range(4)]  # noqa: B023
        cost = [cost[a] + m[4 * a + b] for b, a in enumerate(froms)]
        back.append(froms)
    ends = [c + INSERT * len(_END[s]) for s, c in enumerate(cost)]
    state = min(range(4), key=lambda s: (ends[s], s))
    total, states = ends[state], [state]
    for froms in reversed(back):
        states.append(froms[states[-1]])
    return total, states[::-1]


def repair(classes: list[int], first: int, last: int) -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """The options of a block's turns on a cheapest path from ``first`` to ``last``."""
    cost, back = {first: 0}, []
    for own in classes:
        new: dict[int, tuple[int, int]] = {}
        for (a, b), option in _BEST[own].items():
            if a in cost and (b not in new or (cost[a] + option[0], a) < new[b]):
                new[b] = (cost[a] + option[0], a)
        back.append(new)
        cost = {b: c for b, (c, _) in new.items()}
    out, state = [], last
    for own, new in zip(reversed(classes), reversed(back), strict=True):
        before = new[state][1]
        out.append(_BEST[own][before, state])
        state = before
    return out[::-1]


def _opening(label: int) -> str:
    return f"<|im_start|>{ROLES[label]}\n"


_CLOSING = "<|im_end|>\n"


def piece(text: str | None, option, state: int, is_last: bool) -> str:
    """What a turn adds to the chat text of its conversation, in ``state`` before it."""
    _, after, label, inserted, merged = option
    body = (text or "").replace("<|im_", "<|_im_")
    if merged:
        out = "\n" + body
    else:
        before = "" if state == START else _CLOSING
        out = before + "".join(_opening(i) + _CLOSING for i in inserted) + _opening(label) + body
    if is_last:
        out += _CLOSING + "".join(_opening(i) + _CLOSING for i in _END[after])
    return out


def _blocked(turns: DataFrame, block_turns: int) -> DataFrame:
    """Distinct turns in order, with the block of each and its place there, as a written table."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    name = F.trim(F.lower(F.coalesce("role", F.lit(""))))
    for alias, role in ALIASES.items():
        name = F.when(name == alias, role).otherwise(name)
    rank = F.array_position(F.array(*map(F.lit, ROLES)), name)
    order = [F.col("conv_id"), F.col("turn").isNull(), F.col("turn"), F.when(rank == 0, 4).otherwise(rank), F.xxhash64("text", "role")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*ordered.schema, StructField("block", LongType()), StructField("place", LongType())])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            places = range(at, at + batch.num_rows)
            at += batch.num_rows
            more = [pa.array([first + p // block_turns for p in places], pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=arrow)

    return written(ordered.mapInArrow(number, schema), "turns")


def repaired_turns(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct turn: conv_id, turn, role, new_role, action, n_inserted, cost, rendered, is_last, block, place.

    The ``rendered`` pieces of a conversation, by (block, place), make its chat text.
    ``n_inserted`` counts the empty turns put before the turn; those after the last
    turn are part of its piece.  ``cost`` is that of the whole conversation.
    """
    rows = _blocked(turns, block_turns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def costs(batch: pa.RecordBatch) -> list:
        of = [[role_class(r["role"]) for r in own] for own in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), [block_costs(c) for c in of]]

    roles = F.array_sort(F.collect_list(F.struct("place", "role")))  # at most ``block_turns``
    matrices = map_rows(
        rows.groupBy("conv_id", "block").agg(roles.alias("roles")), costs, f"conv_id {kind}, block long, m array<long>"
    )

    def states(batch: pa.RecordBatch) -> list:
        ids, blocks, firsts, lasts, totals, ends = [], [], [], [], [], []
        for row, own in enumerate(batch.column(1).to_pylist()):
            total, path = chain([b["m"] for b in own])
            for i, b in enumerate(own):
                ids.append(row)
                blocks.append(b["block"])
                firsts.append(path[i])
                lasts.append(path[i + 1])
                totals.append(total)
                ends.append(i == len(own) - 1)
        return [batch.column(0).take(pa.array(ids, pa.int32())), blocks, firsts, lasts, totals, ends]

    chained = matrices.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("blocks"))
    path = map_rows(
        chained, states, f"__id {kind}, __block long, first int, last int, cost long, is_end boolean"
    )
    path = written(path, "block-states")
    same = F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("block") == F.col("__block"))
    joined = rows.join(path, same).drop("__id", "__block")
    joined = joined.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    schema = StructType.fromDDL(
        "new_role string, action string, n_inserted int, rendered string, is_last boolean"
    )
    out = StructType([rows.schema["conv_id"], rows.schema["turn"], rows.schema["role"], *schema,
                      StructField("cost", LongType()), rows.schema["block"], rows.schema["place"]])
    arrow = to_arrow_schema(out)

    def finished(own: list[dict]) -> list[dict]:
        options = repair([role_class(r["role"]) for r in own], own[0]["first"], own[0]["last"])
        state, found = own[0]["first"], []
        for i, (r, option) in enumerate(zip(own, options, strict=True)):
            is_last = r["is_end"] and i == len(own) - 1
            relabelled = option[2] != role_class(r["role"])
            action = "+".join(n for n, on in (("relabel", relabelled), ("merge", option[4])) if on) or "keep"
            found.append(
                {n: r[n] for n in ("conv_id", "turn", "role", "cost", "block", "place")}
                | {"new_role": ROLES[option[2]], "action": action, "n_inserted": len(option[3])}
                | {"rendered": piece(r["text"], option, state, is_last), "is_last": is_last}
            )
            state = option[1]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            groups = [list(g) for _, g in groupby(held, key=lambda r: (r["conv_id"], r["block"]))]
            held = groups.pop() if groups else []  # it may go on
            done = [r for g in groups for r in finished(g)]
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(finished(held), schema=arrow)

    return joined.mapInArrow(run, out)


def chat_texts(repaired: DataFrame) -> DataFrame:
    """(conv_id, cost, text): whole chat texts, for conversations that fit in one row each."""
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "rendered")))
    text = F.concat_ws("", F.transform(parts, lambda p: p["rendered"]))
    return repaired.groupBy("conv_id").agg(F.first("cost").alias("cost"), text.alias("text"))
