"""The rate window calls its state store per span, not per event."""

from __future__ import annotations

from collections import Counter

import pandas as pd

from tidewatch.streaming.state import RateWindow


class Store:
    """Value and map states in memory, and a count of every call."""

    def __init__(self, calls, name):
        self.rows, self.calls, self.name = {}, calls, name

    def __getattr__(self, call):
        self.calls[call] += 1
        return {
            "get": lambda: self.rows.get(()), "update": lambda v: self.rows.update({(): v}), "clear": self.rows.clear, "keys": lambda: list(self.rows),
            "getValue": self.rows.get, "containsKey": self.rows.__contains__, "updateValue": self.rows.__setitem__, "removeKey": self.rows.pop,
        }[call]


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getValueState(self, name, schema):
        return Store(self.calls, name)

    def getMapState(self, name, *schemas):
        return Store(self.calls, name)

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1
        self.timers.add(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_do_not_grow_with_events():
    handle, rates = Handle(), RateWindow(60_000, 2)
    rates.init(handle)
    ms = [i * 45_000 for i in range(1_000)]
    frame = pd.DataFrame({"ms": ms[::-1], "event_id": range(999, -1, -1)})
    list(rates.handleInputRows(("k",), iter([frame.iloc[:600], frame.iloc[600:]]), Clock(0)))
    now = 30_000_000 + 5  # within a slot; what lies in it still waits
    told = pd.concat(rates.handleExpiredTimer(("k",), Clock(now), None))
    told = pd.concat([told, *rates.handleExpiredTimer(("k",), Clock(10**9), None)])
    assert sum(handle.calls.values()) < 60
    start, seen, want = None, 0, []
    for i, at in enumerate(ms):
        if start is None or at >= start + 60_000:
            start, seen = at, 0
        seen += 1
        want.append((i, "k", start, seen <= 2))
    assert list(told.itertuples(index=False, name=None)) == want
    assert min(t for t in handle.timers) == 60_000
