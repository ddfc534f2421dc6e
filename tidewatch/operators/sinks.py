"""Keyed snapshots, ledgers and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.sequence import latest_per_key


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace one row per key. ``updates`` holds each key once."""
    return base.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def append_new(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose key the ledger does not hold, each key once."""
    return rows.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def count_attempts(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Every write of a key adds one attempt to what is stored."""
    before = base.select(key, F.col("attempts").alias("_before"))
    bumped = (
        updates.join(before, key, "left")
        .withColumn("attempts", (F.coalesce("_before", F.lit(0)) + 1).cast("int"))
        .drop("_before")
    )
    return upsert_latest(base, bumped.select(*base.columns), [key])


def sync_catalog(stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Upsert sources on (kind, url): names, vendors and configs follow the catalog, the
    operator's ``enabled`` flag and the fetch cursor stay."""
    s, c = stored.alias("s"), catalog.alias("c")
    both = s.join(c, ["kind", "url"], "full_outer")
    in_catalog = F.col("c.name").isNotNull()

    def pick(name: str):
        return F.when(in_catalog, F.col(f"c.{name}")).otherwise(F.col(f"s.{name}")).alias(name)

    return both.select(
        "kind",
        "url",
        pick("name"),
        pick("vendor"),
        pick("config"),
        F.coalesce(F.col("s.enabled"), F.lit(True)).alias("enabled"),
        F.col("s.last_fetched_at").alias("last_fetched_at"),
    )


def replay_plan(snapshot: DataFrame, stored_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two passes of a fixture snapshot: earlier texts first (only for addresses not stored yet,
    so nothing is replayed backwards), then the current texts."""
    earlier = (
        snapshot.filter(F.col("previous_content").isNotNull())
        .join(stored_keys, "url", "left_anti")
        .withColumns(
            {
                "content": F.col("previous_content"),
                "title": F.coalesce("previous_title", "title"),
            }
        )
    )
    drop = ["previous_content", "previous_title"]
    return earlier.drop(*drop), snapshot.drop(*drop)


__all__ = [
    "append_new",
    "count_attempts",
    "latest_per_key",
    "replay_plan",
    "sync_catalog",
    "upsert_latest",
]
