"""What stood at each of many instants, against a look through all rows."""

from __future__ import annotations

import datetime as dt
import random

from tidewatch.operators.sequence import as_of


def test_as_of_carries_over_empty_slots(spark):
    rng = random.Random(51)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(hours=rng.randrange(24 * 40))
    rows = [(i, rng.choice("abc") if rng.random() < 0.9 else None, when(), f"v{i}") for i in range(120)]
    asks = [(i, rng.choice("abcd") if rng.random() < 0.9 else None, when()) for i in range(300)]
    got = {
        r.ask: r.found and r.found.value
        for r in as_of(spark.createDataFrame(asks, "ask long, key string, at timestamp"), spark.createDataFrame(rows, "id long, key string, at timestamp, value string"), ["key"], "at", "id", ["value"]).collect()
    }
    want = {}
    for ask, key, at in asks:
        hits = [r for r in rows if r[1] == key and r[2] <= at]
        want[ask] = max(hits, key=lambda r: (r[2], r[0]))[3] if hits else None
    assert got == want
