"""Ordered-neighbour operators that never gather a whole key into one task.

A plain ``lag`` partitions by key, so a key holding a third of all rows becomes one task. Here
every key is cut into time slots: neighbours inside a slot come from a window over (key, slot),
and only the first and last row of each slot travel on to link the slots together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_slot(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(seconds * 1_000_000)).cast("bigint")


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: str,
    payload: list[str],
    slot_seconds: int = 86_400,
) -> DataFrame:
    """Add ``previous`` and ``next``: the payload of the adjacent rows of the same key in
    (``at``, ``tie``) order, null at the ends. ``at`` must not be null."""
    spot = F.struct(F.col(at), F.col(tie), *[F.col(p) for p in payload])
    slotted = df.withColumn("_slot", time_slot(F.col(at), slot_seconds))
    inside = Window.partitionBy(*keys, "_slot").orderBy(at, tie)
    near = slotted.withColumns(
        {"_prev": F.lag(spot).over(inside), "_next": F.lead(spot).over(inside)}
    )
    across = Window.partitionBy(*keys).orderBy("_slot")
    edges = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.min(spot).alias("_first"), F.max(spot).alias("_last"))
        .withColumns(
            {"_before": F.lag("_last").over(across), "_after": F.lead("_first").over(across)}
        )
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                F.col("_slot").alias("_s"), "_before", "_after")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    condition = F.col("_slot") == F.col("_s")
    for one in same:
        condition = condition & one
    return near.join(edges, condition, "left").select(
        *df.columns,
        F.coalesce("_prev", "_before").alias("previous"),
        F.coalesce("_next", "_after").alias("next"),
    )


def as_of(asks: DataFrame, rows: DataFrame, keys: list[str], at: str, tie: str, payload: list[str], slot_seconds: int = 86_400) -> DataFrame:
    """Each ask with ``found``: the payload of the newest row of its keys at or before its own instant, null where there is none.

    Both sides hold the keys and ``at``, which must not be null; of rows at one instant the one with the largest ``tie`` is the
    newest. The sides are put into one order: inside a slot the last row is carried along, and what a slot ends with is
    carried to the next ones, so a key's whole history is never in one task.
    """
    spot = F.struct(*[F.col(p) for p in payload])
    blank = F.lit(None)
    put = rows.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), spot.alias("_row"), blank.cast(asks.select(F.struct(*asks.columns)).schema[0].dataType).alias("_ask"))
    asked = asks.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), blank.cast(rows.schema[tie].dataType).alias("_tie"), blank.cast(rows.select(spot).schema[0].dataType).alias("_row"), F.struct(*asks.columns).alias("_ask"))
    both = put.unionByName(asked).withColumn("_slot", time_slot(F.col("_at"), slot_seconds))
    inside = Window.partitionBy(*keys, "_slot").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.last("_row", ignorenulls=True).over(inside)).filter("_side = 1")
    # One row per slot travels on: the last row it holds, if any.
    ends = both.groupBy(*keys, "_slot").agg(F.max_by("_row", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(across)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_s"), "_before")
    condition = F.col("_slot") == F.col("_s")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return near.join(before, condition, "left").select("_ask.*", F.coalesce("_near", "_before").alias("found"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row per key, by a partial aggregate rather than a sort of the whole group.
    The last order column must make rows distinct."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key with their 1-based rank. The rank filter lets Spark keep only
    ``k`` rows per key and map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
