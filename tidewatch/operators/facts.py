"""A log of vendor facts that grows by passes.

Each pass over classified items appends to three tables and changes none: `made` (one row per fact), `gone` (which fact
another one replaced) and `told` (which facts an item's change event points at). A fact is named by the pass and the item
that made it. Later passes may diff an item again: unchanged text leaves the log alone, an ``update`` replaces the
fact its own item made while that is still held, else what is held on its vendor and dimension.

Only what a pass can touch is read again: facts still held, of the vendors and dimensions that the pass names, from its
oldest event on, and the one before. These are short rows of ids and times; they are followed in order per vendor and dimension.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.sequence import latest_per_key
from tidewatch.session import settle

MADE = "batch long, item_id long, vendor string, dimension string, fact string, valid_from timestamp, kind string"
GONE = "batch long, item_id long, by_batch long, by_item long, at timestamp"
TOLD = "item_id long, batch long, new_batch long, previous_batch long, previous_item long"
_FACT = ["batch", "item_id"]


@dataclass
class Log:
    made: DataFrame
    gone: DataFrame
    told: DataFrame

    def plus(self, more: Log) -> Log:
        return Log(self.made.unionByName(more.made), self.gone.unionByName(more.gone), self.told.unionByName(more.told))


def empty_log(spark: SparkSession) -> Log:
    return Log(*[spark.createDataFrame([], schema) for schema in (MADE, GONE, TOLD)])


def held_facts(log: Log) -> DataFrame:
    return log.made.join(log.gone, _FACT, "left_anti")


def all_facts(log: Log) -> DataFrame:
    """Every fact with what it replaced and what replaced it: the log's `made` columns, previous_batch, previous_item,
    superseded_batch, superseded_by, superseded_at."""
    replaced = log.gone.select(F.col("by_batch").alias("batch"), F.col("by_item").alias("item_id"), F.col("batch").alias("previous_batch"), F.col("item_id").alias("previous_item"))
    replacing = log.gone.select(*_FACT, F.col("by_batch").alias("superseded_batch"), F.col("by_item").alias("superseded_by"), F.col("at").alias("superseded_at"))
    return log.made.join(replaced, _FACT, "left").join(replacing, _FACT, "left")


def _asked(log: Log, events: DataFrame, run_at: Column) -> DataFrame:
    """The pass's events with dates, and whether the item's last fact already says the same."""
    dated = events.filter(F.col("vendor").isNotNull()).withColumn("at", F.coalesce("at", run_at))
    last = latest_per_key(log.told.join(dated.select("item_id"), "item_id", "left_semi"), ["item_id"], [F.col("batch")]).filter("new_batch is not null")
    said = last.select(F.col("new_batch").alias("_batch"), F.col("item_id").alias("_item"), "previous_batch", "previous_item").join(
        log.made.select(F.col("batch").alias("_batch"), F.col("item_id").alias("_item"), F.col("fact").alias("_fact")), ["_batch", "_item"]
    )
    joined = dated.join(said, F.col("item_id") == F.col("_item"), "left")
    return joined.withColumn("unchanged", F.coalesce(F.col("_fact") == F.col("after"), F.lit(False))).drop("_item", "_fact")


_STEP = "vendor string, dimension string, item_id long, failed boolean, previous_batch long, previous_item long"


def _follow(now: int):
    """Rows of one vendor and dimension in order: held facts, oldest first, then the pass's events by time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, taken, left, newest = None, [], set(), 0, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if (row.vendor, row.dimension) != key:
                    key, held, taken, left, newest = (row.vendor, row.dimension), [], set(), 0, None
                if row.step == 0:
                    held.append((row.us, row.batch, row.item_id))
                    left = len(held)
                    continue
                target = None if row.target_batch < 0 else (row.target_us, row.target_batch, row.target_item)
                victim = failed = None
                if row.step == 1 and row.kind in ("update", "remove") and target:
                    at = bisect_left(held, target, 0, left)
                    if at < left and held[at] == target and target not in taken:
                        victim = target
                        taken.add(target)
                    else:
                        failed = row.kind == "remove" or row.more
                if row.kind == "remove":
                    if failed:
                        out.append((*key, row.item_id, True, None, None))
                    else:
                        out.append((*key, row.item_id, False, victim[1], victim[2]))
                    continue
                if row.kind == "update" and victim is None:
                    while left and held[left - 1] in taken:
                        left -= 1
                    if left and (newest is None or held[left - 1][0] > newest[0]):
                        left -= 1
                        victim = held[left]
                    elif newest is not None:
                        victim = newest
                newest = (row.us, now, row.item_id)
                if failed:
                    out.append((*key, row.item_id, True, None, None))
                elif victim:
                    out.append((*key, row.item_id, False, victim[1], victim[2]))
            yield pd.DataFrame(out, columns=["vendor", "dimension", "item_id", "failed", "previous_batch", "previous_item"]).astype(
                {"item_id": "int64", "failed": "bool", "previous_batch": "Int64", "previous_item": "Int64"}
            )

    return run


def _replaced(held: DataFrame, making: DataFrame, now: int) -> DataFrame:
    """(item_id, previous_batch, previous_item) for the pass's facts that replace one.

    An item's own held facts are tried newest first. One that lies under another vendor or dimension is taken away there at the
    time of the event; should it prove gone by then, the item's next one is tried in another round. A fact found gone
    stays so whatever later rounds find, so rounds end, and nearly always the first is the last.
    """
    key = ["vendor", "dimension"]
    spot = F.struct(F.unix_micros("valid_from").alias("us"), "batch", F.col("item_id").alias("item"), *key)
    updates = making.filter("kind = 'update'").select("item_id")
    own = held.join(updates, "item_id", "left_semi").select("item_id", spot.alias("_spot")).groupBy("item_id").agg(F.reverse(F.array_sort(F.collect_list("_spot"))).alias("own"))
    tried = settle(making.select("item_id", *key, "kind", F.unix_micros("at").alias("us")).join(own, "item_id", "left").withColumn("round", F.lit(0)))
    own_facts = tried.select(F.inline("own")).select("us", "batch", F.col("item").alias("item_id"), *key)
    lowest = tried.groupBy(*key).agg(F.min("us").alias("_low"))
    # Names the pass doesn't touch are left out before anything is compared.
    mine = held.select(*key, F.unix_micros("valid_from").alias("us"), *_FACT).join(lowest, key)
    suffix = mine.filter("us >= _low").drop("_low")
    # An event without any before it in the pass may meet one older fact: the newest, be it one that another event takes away or not.
    older = mine.filter("us < _low").join(own_facts.select("batch", "item_id"), _FACT, "left_anti")
    before = older.groupBy(*key).agg(F.max(F.struct("us", "batch", "item_id")).alias("_m")).select(*key, "_m.*")
    loaded = settle(suffix.unionByName(before).unionByName(own_facts).distinct())

    none = F.lit(-1).cast("long")
    while True:
        aim = F.get("own", F.col("round"))
        here = (aim["vendor"] == F.col("vendor")) & (aim["dimension"] == F.col("dimension"))
        aimed = tried.withColumns({"_aim": aim, "_here": F.coalesce(here, F.lit(False)), "more": F.size(F.coalesce("own", F.array())) > F.col("round") + 1})
        target = lambda s: [F.coalesce(F.when(s, F.col("_aim")[c]), none).alias(f"target_{c}") for c in ("us", "batch", "item")]
        kind = F.when(F.col("_aim").isNotNull() & ~F.col("_here"), "insert").otherwise(F.col("kind"))
        events = aimed.select(*key, F.lit(1).alias("step"), "us", F.lit(now).cast("long").alias("batch"), "item_id", kind.alias("kind"), "more", *target(F.col("_here")))
        away = aimed.filter(F.col("_aim").isNotNull() & ~F.col("_here")).select(
            F.col("_aim.vendor").alias("vendor"), F.col("_aim.dimension").alias("dimension"), F.lit(1).alias("step"), "us", F.lit(now).cast("long").alias("batch"), "item_id",
            F.lit("remove").alias("kind"), "more", *target(F.lit(True)),
        )
        old = loaded.select(*key, F.lit(0).alias("step"), "us", "batch", "item_id", F.lit("").alias("kind"), F.lit(False).alias("more"), *[none.alias(f"target_{c}") for c in ("us", "batch", "item")])
        rows = old.unionByName(events).unionByName(away).repartition(*key).sortWithinPartitions(*key, "step", "us", "batch", "item_id")
        done = settle(rows.mapInPandas(_follow(now), _STEP))
        failed = done.filter("failed").select("item_id").distinct()
        if failed.isEmpty():
            return done.filter("previous_batch is not null").select("item_id", "previous_batch", "previous_item")
        tried = settle(tried.join(failed.withColumn("_f", F.lit(1)), "item_id", "left").withColumn("round", F.col("round") + F.coalesce("_f", F.lit(0))).drop("_f"))


def advance(log: Log, events: DataFrame, batch: int, run_at: Column) -> Log:
    """What a pass over classified items adds to the log.

    events: item_id (one row per item), vendor, dimension, kind, after, at, evidence (ids, for restatements). Items are taken
    oldest first, by (at, item_id), as one after the other would change the facts the next one meets; undated ones hold from
    ``run_at``. Items without a vendor make no fact and point at none. Of facts with one date the one made later is
    the newer. Give passes rising numbers.
    """
    asked = settle(_asked(log, events, run_at))
    held = held_facts(log)
    making = asked.filter(~F.col("unchanged") & F.col("kind").isin("new", "update"))
    made = making.select(F.lit(batch).cast("long").alias("batch"), "item_id", "vendor", "dimension", F.col("after").alias("fact"), F.col("at").alias("valid_from"), "kind")
    previous = settle(_replaced(held, making, batch))
    gone = previous.join(making.select("item_id", "at"), "item_id").select(
        F.col("previous_batch").alias("batch"), F.col("previous_item").alias("item_id"), F.lit(batch).cast("long").alias("by_batch"), F.col("item_id").alias("by_item"), "at"
    )
    now = F.lit(batch).cast("long")
    nothing = F.lit(None).cast("long")
    new_told = making.select("item_id").join(previous, "item_id", "left").select("item_id", now.alias("batch"), now.alias("new_batch"), "previous_batch", "previous_item")
    same_told = asked.filter("unchanged").select("item_id", now.alias("batch"), F.col("_batch").alias("new_batch"), "previous_batch", "previous_item")
    restated = asked.filter(~F.col("unchanged") & F.col("kind").isin("rephrase", "duplicate"))
    links = _restated(restated, held, made, gone).select("item_id", now.alias("batch"), nothing.alias("new_batch"), "previous_batch", "previous_item")
    unnamed = events.filter("vendor is null").select("item_id", now.alias("batch"), *[nothing.alias(c) for c in ("new_batch", "previous_batch", "previous_item")])
    return Log(made, gone, new_told.unionByName(same_told).unionByName(links).unionByName(unnamed))


def _restated(restated: DataFrame, held: DataFrame, made: DataFrame, gone: DataFrame) -> DataFrame:
    """The newest fact of the first other evidence item that is held when the restatement's turn comes."""
    asked = restated.select("item_id", "at", F.get(F.filter("evidence", lambda x: x != F.col("item_id")), 0).alias("_about"))
    facts = held.select(*_FACT, "valid_from", F.lit(True).alias("_old")).unionByName(made.select(*_FACT, "valid_from", F.lit(False).alias("_old")))
    facts = facts.join(gone.select(*_FACT, F.struct(F.col("at").alias("at"), F.col("by_item").alias("item_id")).alias("_gone")), _FACT, "left")
    facts = facts.select(F.col("item_id").alias("_about"), F.col("batch").alias("_batch"), "valid_from", "_old", "_gone")
    mine = F.struct(F.col("at"), F.col("item_id"))
    there = F.col("_old") | (F.struct(F.col("valid_from").alias("at"), F.col("_about").alias("item_id")) < mine)
    alive = F.col("_gone").isNull() | (F.col("_gone") > mine)
    newest = F.max(F.when(there & alive, F.struct("valid_from", "_batch", "_about")))
    found = asked.join(facts, "_about", "left").groupBy("item_id").agg(newest.alias("_f"))
    return found.select("item_id", F.col("_f._batch").alias("previous_batch"), F.col("_f._about").alias("previous_item"))
