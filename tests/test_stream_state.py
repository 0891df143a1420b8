"""The state of the stream cache against a plain statement, called as Spark calls it."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import Row

from gatelens.streaming import cache, sse


class _Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Map(dict):
    getValue = dict.get
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class _Handle:
    """State of one key, and its timers."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def _state(self, kind, name):
        return self.states.setdefault(name, kind())

    def getValueState(self, name, schema):
        return self._state(_Value, name)

    def getMapState(self, name, *schemas):
        return self._state(_Map, name)

    def registerTimer(self, at):
        self.timers.add(at)

    def passed(self, operator, watermark):
        """What the timers up to a watermark give, in their order."""
        out = []
        while due := [t for t in self.timers if t <= watermark]:
            self.timers.discard(min(due))
            info = type("Info", (), {"getExpiryTimeInMs": lambda _, at=min(due): at})()
            out += operator.handleExpiredTimer(("k",), None, info)
        return out


def _fills_by_hand(times, ttl):
    fill, out = None, {}
    for t in sorted(times):
        fill = t if fill is None or t >= fill + ttl else fill
        out[t] = fill
    return out


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_requests_wait_in_pieces(monkeypatch, held):
    """Answers are those of the rule however the requests come, and no list of all is held."""
    monkeypatch.setattr(cache, "_ROWS_HELD", held)
    monkeypatch.setattr(cache, "_SPAN", 2)
    handle, operator = _Handle(), cache._Fills(10)
    operator.init(handle)
    times = [(i * 7919 % 1000) * 1_000_003 // 7 for i in range(400)] * 2
    first, second = times[:300], times[300:]
    got = []
    for part, watermark in ((first, 0), (second, 60_000), ([], 10**9)):
        for i in range(0, len(part), 50):
            some = part[i : i + 50]
            batches = iter([pd.DataFrame({"t": some[:20], "request_id": some[:20]}), pd.DataFrame({"t": some[20:], "request_id": some[20:]})])
            assert list(operator.handleInputRows(("k",), batches, None)) == []
        sizes = [len(operator._get(*at)) for at in handle.states["waiting"]]
        assert sum(sizes) + sum(map(len, got)) >= len(part) and max(sizes, default=0) <= max(held, 50)
        got += handle.passed(operator, watermark)
    rows = pd.concat(got)
    want = _fills_by_hand(times, 10_000_000)
    assert len(rows) == len(times) and rows["request_id"].astype(int).tolist() == rows["t"].tolist()
    assert rows["filled_at"].tolist() == [want[t] for t in rows["t"]]
    assert (rows["status"] == "fill").tolist() == [want[t] == t for t in rows["t"]]
    assert not handle.states["waiting"] and not handle.states["pieces"] and not handle.states["fill"].exists()


class _Counted(_Value):
    calls = 0

    def get(self):
        _Counted.calls += 1
        return self.value

    def update(self, value):
        _Counted.calls += 1
        self.value = value


def test_a_stream_is_one_value_with_few_calls():
    """Lines in two parts and the end of a stream: three reads, three writes, and timers only where they move."""
    handle, operator = _Handle(), sse._Records(1000, 10_000)
    handle.deleteTimer = handle.timers.discard
    handle.getValueState = lambda name, schema: handle._state(_Counted, name)
    operator.init(handle)
    none = dict.fromkeys(("prompt", "model", "strategy", "latency_ms"))
    line = lambda seq, delta, done, at: Row(seq=seq, delta=delta, done=done, at_ms=at, **none)
    asked = Row(seq=None, delta=None, done=False, at_ms=0, prompt=None, model="m", strategy="s", latency_ms=5)
    _Counted.calls = 0
    assert list(operator.handleInputRows((1,), iter([line(2, "c", False, 20), asked, line(9, None, True, 30)]), None)) == []
    assert handle.timers == {31}
    assert list(operator.handleInputRows((1,), iter([line(1, "b", False, 40), line(0, "a", False, None)]), None)) == []
    assert handle.timers == {41}
    got = handle.passed(operator, 50)
    assert [r.asDict() for r in got] == [{"stream_id": "k", "text": "abc", "prompt": None, "model": "m", "strategy": "s", "latency_ms": 5}]
    assert _Counted.calls == 6 and handle.timers == {10_041} and len(handle.states) == 1
    assert list(operator.handleInputRows((1,), iter([line(3, "late", False, 60)]), None)) == [] and handle.timers == {10_041}
    assert handle.passed(operator, 10_041) == [] and not handle.states["state"].exists()
