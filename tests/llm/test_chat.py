"""Role repair against a search of all repairs, and legal texts for all conversations."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from gatelens.llm import chat, queries

LEGAL = re.compile(r"(<\|im_start\|>system\n[^<]*<\|im_end\|>\n)?(<\|im_start\|>user\n[^<]*<\|im_end\|>\n"
                   r"<\|im_start\|>assistant\n[^<]*<\|im_end\|>\n)+")  # fmt: skip


def brute_cost(classes):
    """Least cost over all labels, merges and numbers of inserted turns."""
    best = 1 << 40
    for labels in itertools.product(range(3), repeat=len(classes)):
        base = sum(0 if x == c else chat.UNKNOWN if c == 3 else chat.RELABEL for x, c in zip(labels, classes, strict=True))
        for merges in itertools.product([False, True], repeat=max(0, len(classes) - 1)):
            own = list(zip(labels, [False, *merges], strict=True))
            if any(m and labels[i] != labels[i - 1] for i, (_, m) in enumerate(own)):
                continue
            turns = [x for x, m in own if not m]
            cost, want, ok = base + chat.MERGE * sum(merges), 1, True
            for i, x in enumerate(turns):
                if x == 0:
                    ok &= i == 0
                else:
                    cost += chat.INSERT * (x != want)
                    want = 3 - x
            # a start without user turns, or an open user turn, is filled up
            if want == 2 or not any(turns):
                cost += chat.INSERT * (1 if want == 2 else 2)
            if ok:
                best = min(best, cost)
    return best


def test_costs():
    for n in range(1, 5):
        for classes in itertools.product(range(4), repeat=n):
            total, states = chat.chain([chat.block_costs(list(classes[:2])), chat.block_costs(list(classes[2:]))])
            assert total == brute_cost(classes), classes
            first = chat.repair(list(classes[:2]), states[0], states[1])
            second = chat.repair(list(classes[2:]), states[1], states[2])
            assert sum(o[0] for o in first + second) + chat.INSERT * len(chat._END[states[2]]) == total


def test_whole_query(spark, sf_dir):
    rows = queries.op5_chat_formatting(spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert len(rows) == turns.select("conv_id", "turn", "role", "text").distinct().count()
    by = {}
    for r in turns.distinct().collect():
        by.setdefault(r.conv_id, []).append((r.turn is None, r.turn or 0, chat.role_class(r.role)))
    costs = {c: chat.chain([chat.block_costs([k for *_, k in sorted(own)])])[0] for c, own in by.items()}
    assert {(r.conv_id, r.cost) for r in rows} == set(costs.items())
    assert sorted(r.conv_id for r in rows if r.is_last) == sorted(costs)
    texts = chat.chat_texts(chat.repaired_turns(turns.withColumn("text", turns.text))).collect()
    assert all(LEGAL.fullmatch(re.sub(r"<(?!\|im_)", "(", t.text)) for t in texts)


@pytest.mark.parametrize("block_turns", [3, 512])
def test_blocks_repair_alike(spark, block_turns):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["system", "user", "Human", "assistant", "tool", None]), f"c{c}t{t}")
            for c, n in enumerate([1, 2, 3, 7, 400, 60]) for t in range(n)]
    found = chat.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), block_turns)
    texts = {r.conv_id: r for r in chat.chat_texts(found).collect()}
    for c in range(6):
        own = [r for r in rows if r[0] == c]
        assert texts[c].cost == chat.chain([chat.block_costs([chat.role_class(r[2]) for r in own])])[0]
        assert LEGAL.fullmatch(texts[c].text)
        assert re.findall(r"c\dt\d+", texts[c].text) == [r[3] for r in own]


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "system", "s"), (1, None, "user", None), (None, 3, None, "<|im_end|>"),
            (2, 1, "assistant", "x " * 50000)]
    df = spark.createDataFrame([(*r, "extra", 9) for r in rows], "conv_id long, turn long, role string, text string, block string, cost int")
    texts = {r.conv_id: r.text for r in chat.chat_texts(chat.repaired_turns(df)).collect()}
    assert texts[1].startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na")
    assert texts[None].count("<|im_end|>") == 2 and "<|_im_end|>" in texts[None]
    assert texts[2].startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx x")
    assert chat.repaired_turns(df.limit(0)).collect() == []
