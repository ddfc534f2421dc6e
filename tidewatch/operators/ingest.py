"""Normalise, dedupe and upsert landed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import pinned
from tidewatch.functions.text import collapse, content_hash, trim_all
from tidewatch.functions.urls import canonical_url, url_hash
from tidewatch.operators.sequence import latest_per_key
from tidewatch.session import settle

CONTENT_COLUMNS = ["external_id", "url", "content_hash", "title", "author", "content", "published_at"]


def normalise(items: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """Canonical address, collapsed title, body (falling back to the title), both hashes and a
    ``reject_reason`` that is null for usable rows. Needs url, title, content, author."""
    body = trim_all(F.coalesce("content", F.lit("")))
    author = trim_all(F.col("author"))
    shaped = pinned(
        items,
        {
            "canonical_url": canonical_url(F.col("url")),
            "url": trim_all(F.col("url")),
            "title": collapse(F.coalesce("title", F.lit(""))),
            "author": F.when(author != "", author),
            "content": body,
        },
    ).withColumn("content", F.when(F.col("content") != "", F.col("content")).otherwise(F.col("title")))
    reason = F.when(F.col("canonical_url").isNull(), "invalid url").when(
        F.col("title") == "", "empty title"
    )
    return shaped.withColumns(
        {
            "url_hash": url_hash(F.col("canonical_url")),
            "content_hash": content_hash(F.col("title"), F.col("content"), unicode_forms),
            "reject_reason": reason,
        }
    )


def accepted(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(normalised: DataFrame, *keep: str) -> DataFrame:
    return normalised.filter(F.col("reject_reason").isNotNull()).select(*keep, "title", "url", "reject_reason")


def first_wins(
    items: DataFrame,
    order: str,
    scope: list[str] | None = None,
    keys: tuple[str, str] = ("url_hash", "content_hash"),
) -> DataFrame:
    """Keep a row iff neither of its keys was used by an earlier *kept* row of its scope.

    A dropped row never blocks a later one, so two ``dropDuplicates`` would be wrong. Each round keeps
    the rows that come first in both of their groups. A row with exactly one earlier rival is kept
    iff that rival is not, so chains of such rows are followed by pointer doubling and decided in the
    same round, in steps logarithmic in their length. Then what collides with a kept row is dropped.
    Minima are partial aggregates: a key shared by a third of the rows collapses map-side.
    ``order`` must be unique inside a scope.
    """
    scope = scope or []
    a, b = keys
    # Copies agreeing on both keys stand or fall with the earliest of them.
    open_rows = settle(items.groupBy(*scope, a, b).agg(F.min(order).alias(order)))
    kept: list[DataFrame] = []
    while not open_rows.isEmpty():
        ranked = settle(_rivals(open_rows, order, scope, keys))
        winners = ranked.filter("_ahead = 0").select(*scope, a, b, order)
        chained = _decided(ranked, order, scope).select(*scope, a, b, order)
        taken = settle(winners.unionByName(chained))
        kept.append(taken)
        open_rows = settle(
            open_rows.join(taken.select(*scope, a), [*scope, a], "left_anti").join(taken.select(*scope, b), [*scope, b], "left_anti")
        )
    if not kept:
        return items.limit(0)
    survivors = kept[0]
    for more in kept[1:]:
        survivors = survivors.unionByName(more)
    return items.join(survivors.select(*scope, order), [*scope, order], "left_semi")


def _rivals(open_rows: DataFrame, order: str, scope: list[str], keys: tuple[str, str]) -> DataFrame:
    """Add ``_ahead``, the number of earlier rows that share a key (2 stands for more), and ``_to``,
    the only such row where there is one."""
    out = open_rows
    for key in keys:
        heads = open_rows.groupBy(*scope, key).agg(F.min(order).alias(f"_first_{key}"))
        out = out.join(heads, [*scope, key])
    for key in keys:
        seconds = out.filter(F.col(order) > F.col(f"_first_{key}")).groupBy(*scope, key).agg(F.min(order).alias(f"_second_{key}"))
        out = out.join(seconds, [*scope, key], "left")
    ahead, to = F.lit(0), F.lit(None)
    for key in keys:
        place = F.when(F.col(order) == F.col(f"_first_{key}"), 0).when(F.col(order) == F.col(f"_second_{key}"), 1).otherwise(2)
        ahead, to = ahead + place, F.coalesce(to, F.when(place == 1, F.col(f"_first_{key}")))
    # A row that is second in both groups may have one rival there and the same one here.
    first_a, first_b = (F.col(f"_first_{key}") for key in keys)
    ahead = F.when((ahead == 2) & (first_a == first_b) & (F.col(order) == F.col(f"_second_{keys[0]}")) & (F.col(order) == F.col(f"_second_{keys[1]}")), 1).otherwise(F.least(ahead, F.lit(2)))
    return out.select(*open_rows.columns, ahead.alias("_ahead"), to.alias("_to"))


def _decided(ranked: DataFrame, order: str, scope: list[str]) -> DataFrame:
    """Rows with one rival that are kept because their chain of single rivals ends, an even number
    of steps away, in a row without any."""
    hops = ranked.filter("_ahead = 1").withColumn("_odd", F.lit(True))
    roots = ranked.filter("_ahead = 0").select(*scope, F.col(order).alias("_to"))
    while True:
        onward = hops.select(*scope, F.col(order).alias("_to"), F.col("_to").alias("_far"), F.col("_odd").alias("_odd_far"))
        joined = hops.join(onward, [*scope, "_to"], "left")
        longer = settle(
            joined.withColumns({"_to": F.coalesce("_far", "_to"), "_odd": F.when(F.col("_far").isNull(), F.col("_odd")).otherwise(F.col("_odd") != F.col("_odd_far"))})
        )
        hops = longer.select(*ranked.columns, "_odd")
        if longer.filter("_far is not null").isEmpty():
            return hops.filter("not _odd").join(roots, [*scope, "_to"], "left_semi")


def first_wins_report(items: DataFrame, kept: DataFrame, order: str, scope: list[str]) -> DataFrame:
    """Why each row was kept or collapsed: ``kept``, ``repeated url`` or ``repeated body``."""
    by_url = kept.select(*scope, "url_hash", F.col(order).alias("_u"))
    by_body = kept.select(*scope, "content_hash", F.col(order).alias("_c"))
    verdict = (
        F.when(F.col("_u") == F.col(order), "kept")
        .when(F.col("_u") < F.col(order), "repeated url")
        .otherwise("repeated body")
    )
    return (
        items.join(by_url, [*scope, "url_hash"], "left")
        .join(by_body, [*scope, "content_hash"], "left")
        .withColumn("outcome", verdict)
        .drop("_u", "_c")
    )


def classify_upsert(base: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Give each batch row its ``status``: unchanged, revised, duplicate or inserted.

    ``batch`` holds each url and each body once (see :func:`first_wins`). The twin test honours
    arrival order: a stored body rewritten by an earlier row of the batch is no longer a twin.
    """
    stored = base.select("url_hash", F.col("content_hash").alias("_stored"))
    known = batch.join(stored, "url_hash", "left")
    revising = known.filter(
        F.col("_stored").isNotNull() & (F.col("_stored") != F.col("content_hash"))
    ).select("url_hash", F.col(order).alias("_revised_at"))
    never = F.lit(2**62)
    twins = (
        base.select("url_hash", "content_hash")
        .join(revising, "url_hash", "left")
        .groupBy("content_hash")
        .agg(F.max(F.coalesce("_revised_at", never)).alias("_twin_until"))
    )
    status = (
        F.when(F.col("_stored") == F.col("content_hash"), "unchanged")
        .when(F.col("_stored").isNotNull(), "revised")
        .when(F.col("_twin_until") > F.col(order), "duplicate")
        .otherwise("inserted")
    )
    return known.join(twins, "content_hash", "left").withColumn("status", status).drop("_stored", "_twin_until")


def upsert(
    base: DataFrame, batch: DataFrame, fetched_at: Column, order: str = "seq"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a batch: (new base, pre-images of the rows it rewrote, classified batch).

    A revision rewrites the content columns but keeps ``source_id`` and ``canonical_url``.
    """
    classified = classify_upsert(base, batch, order)
    columns = base.columns
    fresh = classified.filter("status = 'revised'").select(
        "url_hash", F.struct(*CONTENT_COLUMNS).alias("_new")
    )
    joined = base.join(fresh, "url_hash", "left")
    rewritten = joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in CONTENT_COLUMNS
            else F.when(F.col("_new").isNotNull(), fetched_at).otherwise(F.col(c)).alias(c)
            if c == "fetched_at"
            else F.col(c)
            for c in columns
        ]
    )
    inserted = (
        classified.filter("status = 'inserted'").withColumn("fetched_at", fetched_at).select(*columns)
    )
    pre_images = (
        joined.filter(F.col("_new").isNotNull()).select(*columns).withColumn("revised_at", fetched_at)
    )
    return rewritten.unionByName(inserted), pre_images, classified


STATUSES = ["inserted", "revised", "unchanged", "duplicate"]


def upsert_report(classified: DataFrame, source: str = "source_id") -> DataFrame:
    """Counts per source plus the overall row (source null)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return classified.rollup(source).agg(F.count("*").alias("fetched"), *counts)


def changed_keys(classified: DataFrame) -> DataFrame:
    """Exactly the items the derived stages must rebuild."""
    return classified.filter(F.col("status").isin("inserted", "revised")).select("url_hash")


def latest_revision(revisions: DataFrame, item: str = "raw_item_id") -> DataFrame:
    return latest_per_key(revisions, [item], [F.col("revised_at"), F.col("revision_id")])


def isolate_failures(payloads: DataFrame, parsed: DataFrame, source: str) -> DataFrame:
    """One report row per source: ``failed`` when nothing of its payload could be read."""
    good = parsed.groupBy(source).agg(F.count("*").alias("items"))
    return (
        payloads.select(source)
        .distinct()
        .join(good, source, "left")
        .select(
            source,
            F.coalesce("items", F.lit(0)).alias("items"),
            F.when(F.col("items").isNull(), "failed").otherwise("ok").alias("status"),
        )
    )
