"""Rate windows anchored at the first event, over a whole history at once.

A key's window opens at the first event after the previous window expired, so window starts form a
chain: each start leads to the first event at least one window length later. The chain is followed
by pointer doubling over equi-joins, which keeps every step distributed even when one key holds a
third of all events. Timestamps count in whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.sequence import top_per_key
from tidewatch.schemas import RATE_MAX_EVENTS, RATE_WINDOW_MS
from tidewatch.session import settle


def _successors(instants: DataFrame, width: int) -> DataFrame:
    """For each (key, ms) the first instant of the key at least ``width`` later (``jump``).

    It lies in the aligned slot after the row's own, or else opens the next non-empty slot; so the
    windows below never hold more than two slots of one key.
    """
    slotted = instants.withColumn("slot", F.floor(F.col("ms") / width))
    asks = slotted.select("key", (F.col("slot") + 1).alias("slot"), (F.col("ms") + width).alias("t"), F.col("ms").alias("asker"))
    events = slotted.select("key", "slot", F.col("ms").alias("t"), F.lit(None).cast("bigint").alias("asker"))
    # Descending, so that a frame grows with its row and is never added up anew.
    ahead = Window.partitionBy("key", "slot").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        asks.unionByName(events)
        .withColumn("near", F.min(F.when(F.col("asker").isNull(), F.col("t"))).over(ahead))
        .filter("asker is not null")
        .select("key", F.col("asker").alias("ms"), "near", F.col("slot").alias("next_slot"))
    )
    openings = slotted.groupBy("key", "slot").agg(F.min("ms").alias("opens"))
    asked = slotted.select("key", (F.col("slot") + 1).alias("slot")).distinct().withColumn("opens", F.lit(None).cast("bigint"))
    later = Window.partitionBy("key").orderBy(F.desc("slot")).rangeBetween(Window.unboundedPreceding, -1)
    far = (
        openings.unionByName(asked)
        .groupBy("key", "slot").agg(F.min("opens").alias("opens"))
        .withColumn("far", F.min("opens").over(later))
        .select("key", F.col("slot").alias("next_slot"), "far")
    )
    return inside.join(far, ["key", "next_slot"]).select("key", "ms", F.coalesce("near", "far").alias("jump"))


def window_starts(instants: DataFrame, width: int) -> DataFrame:
    """The instants (key, ms) at which a new window opens. Each round doubles the length of the chain
    that is known and of the jumps, until no jump is left that stays inside the history."""
    jumps = settle(_successors(instants, width).filter("jump is not null"))
    starts = instants.groupBy("key").agg(F.min("ms").alias("ms"))
    while not jumps.isEmpty():
        reached = starts.join(jumps, ["key", "ms"]).select("key", F.col("jump").alias("ms"))
        starts = settle(starts.unionByName(reached).distinct())
        onward = jumps.select("key", F.col("ms").alias("jump"), F.col("jump").alias("far"))
        jumps = settle(jumps.join(onward, ["key", "jump"]).select("key", "ms", F.col("far").alias("jump")))
    return starts


def rate_limit(
    events: DataFrame, key: str, at: str, event_id: str, width: int = RATE_WINDOW_MS, budget: int = RATE_MAX_EVENTS
) -> DataFrame:
    """Each event with its window start and whether it fits the budget."""
    rows = events.withColumns({"key": F.col(key), "ms": F.unix_millis(at)}).withColumn("slot", F.floor(F.col("ms") / width))
    starts = window_starts(rows.select("key", "ms").distinct(), width)
    near = starts.select("key", F.col("ms").alias("start")).withColumn("slot", F.floor(F.col("start") / width))
    near = near.unionByName(near.withColumn("slot", F.col("slot") + 1)).groupBy("key", "slot").agg(
        F.min("start").alias("early"), F.max("start").alias("late")
    )
    # A slot is met by at most two windows: one reaching in from before, one opening inside.
    placed = rows.join(near, ["key", "slot"]).withColumn(
        "window_ms", F.when(F.col("late") <= F.col("ms"), F.col("late")).otherwise(F.col("early"))
    )
    fits = top_per_key(
        placed.select("key", "window_ms", "ms", event_id), ["key", "window_ms"], [F.col("ms"), F.col(event_id)], budget
    ).select(event_id, F.lit(True).alias("_ok"))
    return (
        placed.join(fits, event_id, "left")
        .withColumns({"allowed": F.coalesce("_ok", F.lit(False)), "window_start": F.timestamp_millis("window_ms")})
        .select(*events.columns, "window_start", "allowed")
    )
