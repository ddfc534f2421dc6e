"""The fact log over several passes against a replay one item after the other."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewatch.operators import changes, facts

SCHEMA = "item_id long, vendor string, dimension string, kind string, after string, at timestamp, evidence array<long>"
START = dt.datetime(2024, 1, 1)


class Plain:
    """One item after the other, as lists."""

    def __init__(self):
        self.made, self.gone, self.told = [], {}, {}

    def one(self, batch, item, vendor, dimension, kind, after, at, evidence):
        if vendor is None:
            self.told[item] = (None, None)
            return
        have = self.told.get(item, (None, None))
        if have[0] is not None and next(f for f in self.made if f[:2] == have[0])[4] == after:
            return
        alive = [f for f in self.made if f[:2] not in self.gone]
        newest = lambda some: max(some, key=lambda f: (f[5], f[0], f[1]), default=None)
        if kind in ("new", "update"):
            previous = None
            if kind == "update":
                previous = newest([f for f in alive if f[1] == item]) or newest([f for f in alive if f[2:4] == (vendor, dimension)])
            self.made.append((batch, item, vendor, dimension, after, at))
            if previous:
                self.gone[previous[:2]] = (batch, item)
            self.told[item] = ((batch, item), previous and previous[:2])
        else:
            about = next((x for x in evidence if x != item), None)
            found = newest([f for f in alive if f[1] == about])
            self.told[item] = (None, found and found[:2])


def replay(passes, run_at):
    plain = Plain()
    for batch, rows in enumerate(passes):
        for item, vendor, dimension, kind, after, at, evidence in sorted(rows, key=lambda r: (r[5] or run_at, r[0])):
            plain.one(batch, item, vendor, dimension, kind, after, at or run_at, evidence)
    return plain


def run(spark, passes, run_at):
    log = facts.empty_log(spark)
    for batch, rows in enumerate(passes):
        more = facts.advance(log, spark.createDataFrame(rows, SCHEMA), batch, F.lit(run_at))
        log = log.plus(more)
    return log


def same(log, plain):
    assert sorted((r.batch, r.item_id, r.vendor, r.dimension, r.fact) for r in log.made.collect()) == sorted(f[:5] for f in plain.made)
    assert {(r.batch, r.item_id): (r.by_batch, r.by_item) for r in log.gone.collect()} == plain.gone
    last = {}
    for r in sorted(log.told.collect(), key=lambda r: r.batch):
        pair = lambda b, i: None if b is None else (b, i)
        last[r.item_id] = (pair(r.new_batch, r.item_id), pair(r.previous_batch, r.previous_item))
    assert last == plain.told


def test_passes_equal_a_replay(spark):
    rng = random.Random(21)
    run_at = START + dt.timedelta(days=40)
    for _ in range(1):
        passes, known = [], []
        for _ in range(3):
            rows = {}
            for item in [*range(len(known), len(known) + 60), *rng.sample(known, min(len(known), 40))]:
                old = item in known
                at = None if rng.random() < 0.05 else START + dt.timedelta(hours=(item * 37) % 300 if old or rng.random() < 0.7 else rng.randrange(300))
                kind = rng.choice(["new", "update", "update", "rephrase", "duplicate"])
                vendor = None if rng.random() < 0.05 else f"v{(item if rng.random() < 0.9 else rng.randrange(9)) % 3}"
                dimension = f"d{(item if rng.random() < 0.9 else rng.randrange(9)) % 2}"
                rows[item] = (item, vendor, dimension, kind, rng.choice([f"text {item}", f"text {rng.randrange(999)}"]), at, [item, rng.randrange(120)])
            passes.append(list(rows.values()))
            known = sorted({*known, *rows})
        same(run(spark, passes, run_at), replay(passes, run_at))


def test_a_revision_replaces_its_own_fact_and_unchanged_text_nothing(spark):
    day = lambda n: START + dt.timedelta(days=n)
    passes = [
        [(1, "Docker", "pricing", "new", "Business is $21.", day(1), []), (2, "Docker", "pricing", "new", "Team is $9.", day(2), [])],
        [(1, "Docker", "pricing", "update", "Business is $24.", day(1), []), (2, "Docker", "pricing", "update", "Team is $9.", day(2), [])],
    ]
    log = run(spark, passes, day(9))
    same(log, replay(passes, day(9)))
    got = {(r.batch, r.item_id): (r.previous_batch, r.previous_item, r.superseded_batch, r.superseded_by) for r in facts.all_facts(log).collect()}
    assert got == {(0, 1): (None, None, 1, 1), (1, 1): (0, 1, None, None), (0, 2): (None,) * 4}
    assert {(r.batch, r.item_id) for r in facts.held_facts(log).collect()} == {(1, 1), (0, 2)}


def test_one_pass_is_the_full_chain(spark):
    rng = random.Random(22)
    rows = [(i, f"v{rng.randrange(3)}", "d", rng.choice(["new", "update"]), f"t{i}", START + dt.timedelta(minutes=rng.randrange(9000)), []) for i in range(300)]
    events = spark.createDataFrame(rows, SCHEMA)
    chain = {r.fact_id: (r.previous_fact_id, r.superseded_by) for r in changes.fact_chain(events).collect()}
    log = facts.advance(facts.empty_log(spark), events, 0, F.lit(START))
    assert {r.item_id: (r.previous_item, r.superseded_by) for r in facts.all_facts(log).collect()} == chain
    assert facts.advance(log, events, 1, F.lit(START)).made.count() == 0


def test_a_fact_filed_elsewhere_is_taken_away_there(spark):
    day = lambda n: START + dt.timedelta(days=n)
    passes = [
        [(1, "a", "x", "new", "one", day(1), []), (2, "a", "x", "new", "two", day(2), []), (3, "b", "x", "new", "three", day(3), [])],
        # Item 4 comes before and takes what item 2 held, so item 2's revision, now filed under b, falls back on what b holds.
        [(4, "a", "x", "update", "four", dt.datetime(2023, 12, 1), []), (2, "b", "x", "update", "two more", day(2), []), (1, "b", "x", "update", "one more", day(1), [])],
    ]
    log = run(spark, passes, day(9))
    plain = replay(passes, day(9))
    same(log, plain)
    assert plain.gone[(0, 2)] == (1, 4) and plain.gone[(0, 3)] == (1, 2) and plain.gone[(0, 1)] == (1, 1)
