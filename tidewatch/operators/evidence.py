"""Evidence behind a rating: confidence, corroboration, matrix suggestions and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.labels import recency_weight
from tidewatch.functions.text import first_sentence
from tidewatch.operators.neighbours import within
from tidewatch.operators.ranking import best_first, score
from tidewatch.operators.sequence import as_of, latest_per_key, top_per_key
from tidewatch.schemas import (
    CONFIDENCE_HALF_LIFE_DAYS,
    CONFIDENCE_HIGH,
    CONFIDENCE_MEDIUM,
    CONFIDENCE_WEIGHTS,
    CORROBORATION_CAP,
    CORROBORATION_DAYS,
    EVIDENCE_PER_CELL,
    MIN_EVIDENCE_IMPACT,
    SIMILARITY_THRESHOLD,
    SUGGESTIONS,
)

def confidence_score(count: Column, max_impact: Column, freshness: Column, primary: Column) -> Column:
    w = CONFIDENCE_WEIGHTS
    impact = F.least(F.greatest(max_impact, F.lit(0)), F.lit(5)) / 5
    quantity = F.least(count, F.lit(CORROBORATION_CAP)) / CORROBORATION_CAP
    fresh = F.least(F.greatest(freshness, F.lit(0.0)), F.lit(1.0))
    return (
        F.lit(w["impact"]) * impact
        + F.lit(w["corroboration"]) * quantity
        + F.lit(w["freshness"]) * fresh
        + F.lit(w["source"]) * F.when(primary, 1.0).otherwise(0.0)
    )


def confidence_level(value: Column) -> Column:
    return (
        F.when(value >= CONFIDENCE_HIGH, "high").when(value >= CONFIDENCE_MEDIUM, "medium").otherwise("low")
    )


def freshness(at: Column, now: Column) -> Column:
    return F.when(at.isNull(), F.lit(0.0)).otherwise(
        recency_weight(at, now, CONFIDENCE_HALF_LIFE_DAYS, 0.0)
    )


def with_confidence(cells: DataFrame, now: Column) -> DataFrame:
    """cells: evidence_count, max_impact, newest_at, has_primary (nulls read as no evidence)."""
    count, impact = F.coalesce("evidence_count", F.lit(0)), F.coalesce("max_impact", F.lit(0))
    primary = F.coalesce("has_primary", F.lit(False))
    value = confidence_score(count, impact, freshness(F.col("newest_at"), now), primary)
    return cells.withColumns(
        {
            "evidence_count": count,
            "max_impact": impact,
            "freshness": F.round(freshness(F.col("newest_at"), now), 9),
            "has_primary": primary,
            "confidence": confidence_level(F.round(value, 12)),
        }
    )


def vendor_evidence(signals: DataFrame, vendors: DataFrame, now: Column) -> DataFrame:
    """Shown signals of the listed vendors (canonical spelling), with tier and score."""
    names = vendors.select(F.col("vendor").alias("_name"), F.lower("vendor").alias("_key"))
    return (
        signals.withColumn("_key", F.lower("vendor"))
        .join(names, "_key")
        .withColumn("vendor", F.col("_name"))
        .withColumn("score", F.round(score(now), 9))
        .drop("_key", "_name")
    )


def _per_axis(rows: DataFrame, axes: DataFrame) -> DataFrame:
    """Fan rows with a category out to the axes listing it. Axes are a hand-curated handful."""
    wanted = axes.select("axis_id", F.explode("categories").alias("category"))
    return rows.join(wanted, "category")


def cell_evidence(evidence: DataFrame, axes: DataFrame, keep: int = EVIDENCE_PER_CELL) -> tuple[DataFrame, DataFrame]:
    """(aggregates, strongest rows) per (vendor, axis). Signals are reduced per (vendor, category)
    before they fan out to axes, so what crosses the join is a few rows per vendor."""
    notable = evidence.filter(F.col("impact_score") >= MIN_EVIDENCE_IMPACT)
    small = notable.groupBy("vendor", "category").agg(
        F.count("*").alias("n"), F.max("impact_score").alias("impact"), F.max("published_at").alias("newest"),
        F.bool_or(F.col("tier") == "primary").alias("primary"),
    )
    totals = _per_axis(small, axes).groupBy("vendor", "axis_id").agg(
        F.sum("n").alias("evidence_count"), F.max("impact").alias("max_impact"),
        F.max("newest").alias("newest_at"), F.bool_or("primary").alias("has_primary"),
    )
    best = top_per_key(notable, ["vendor", "category"], best_first(), keep, "_n").drop("_n")
    rows = top_per_key(_per_axis(best, axes), ["vendor", "axis_id"], best_first(), keep)
    return totals, rows


def evidence_ids(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return rows.groupBy("vendor", "axis_id").agg(F.transform(ordered, lambda r: r["id"]).alias("evidence"))


def suggestion_id(vendor: Column, axis: Column, signal: Column) -> Column:
    return F.concat_ws("::", vendor, axis, signal.cast("string"))


def drivers(evidence: DataFrame, axes: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Strongest signal per cell whose suggestion nobody has decided on (approve or reject).

    Signals never reviewed on any axis compete per (vendor, category); only reviewed ones need to be
    looked at axis by axis. reviewed: vendor, axis_id, id.
    """
    notable = evidence.filter(F.col("impact_score") >= MIN_EVIDENCE_IMPACT)
    touched = reviewed.select("id").distinct()
    fresh = top_per_key(
        notable.join(touched, "id", "left_anti"), ["vendor", "category"], best_first(), 1, "_n"
    ).drop("_n")
    partly = _per_axis(notable.join(touched, "id", "left_semi"), axes).join(
        reviewed.select("vendor", "axis_id", "id"), ["vendor", "axis_id", "id"], "left_anti"
    )
    every = _per_axis(fresh, axes).unionByName(partly)
    return top_per_key(every, ["vendor", "axis_id"], best_first(), 1, "_n").drop("_n")


def draft_note(level: Column, note: Column, signal: Column, summary: Column) -> Column:
    sentence = F.concat(first_sentence(summary), F.lit(" [#"), signal.cast("string"), F.lit("]"))
    return F.when(
        level.isNull(), F.struct(F.lit("info").alias("level"), sentence.alias("note"))
    ).otherwise(F.struct(level.alias("level"), F.concat(note, F.lit(" — "), sentence).alias("note")))


def suggest(
    evidence: DataFrame, axes: DataFrame, cells: DataFrame, reviewed: DataFrame, now: Column, limit: int = SUGGESTIONS
) -> DataFrame:
    """Cells worth a review, best driver first."""
    totals, rows = cell_evidence(evidence, axes)
    key = ["vendor", "axis_id"]
    out = (
        drivers(evidence, axes, reviewed)
        .join(totals, key)
        .join(evidence_ids(rows), key)
        .join(cells.select("vendor", "axis_id", "level", "note"), key, "left")
    )
    out = with_confidence(out, now)
    return (
        out.select(
            suggestion_id(F.col("vendor"), F.col("axis_id"), F.col("id")).alias("suggestion_id"),
            "vendor", "axis_id",
            F.coalesce("level", F.lit("none")).alias("current_level"),
            F.coalesce("note", F.lit("—")).alias("current_note"),
            draft_note(F.col("level"), F.col("note"), F.col("id"), F.col("summary")).alias("proposed"),
            F.col("id").alias("signal_id"), "impact_score", "score", "evidence", "evidence_count", "confidence",
        )
        .orderBy(F.desc("score"), "suggestion_id")
        .limit(limit)
    )


def explain_cells(
    grid: DataFrame, evidence: DataFrame, axes: DataFrame, cells: DataFrame, approvals: DataFrame, now: Column
) -> DataFrame:
    """Every vendor x axis cell with its rating, evidence, confidence and last approved edit.
    grid: vendor, axis_id. approvals: the result of :func:`latest_approvals`."""
    totals, rows = cell_evidence(evidence, axes)
    key = ["vendor", "axis_id"]
    out = (
        grid.join(cells, key, "left").join(totals, key, "left").join(evidence_ids(rows), key, "left").join(
            approvals.select(
                "vendor", "axis_id", F.col("created_at").alias("last_updated_at"), F.col("signal_id").alias("last_updated_signal_id")
            ), key, "left",
        )
    )
    return with_confidence(out, now).select(
        "vendor", "axis_id", F.coalesce("level", F.lit("none")).alias("level"), F.coalesce("note", F.lit("—")).alias("note"),
        F.coalesce("evidence", F.array().cast("array<bigint>")).alias("evidence"), "evidence_count", "max_impact",
        "freshness", "has_primary", "confidence", "last_updated_at", "last_updated_signal_id",
    )


def full_grid(matrix: DataFrame) -> DataFrame:
    """All vendor x axis keys of the curated asset, unfolded from its single row."""
    return matrix.select(F.explode("vendors").alias("v"), "axes").select("v", F.explode("axes").alias("a")).select(
        F.col("v.name").alias("vendor"), F.col("a.id").alias("axis_id")
    )


def latest_approvals(revisions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest readable approval per cell. revisions: revision_id, vendor, axis_id, action,
    after_json, signal_id, created_at."""
    after = F.from_json("after_json", "struct<level: string, note: string>")
    rows = revisions.filter("action = 'approve'").withColumn("after", after).filter(F.col("after.level").isNotNull())
    if as_of is not None:
        rows = rows.filter(F.col("created_at") <= as_of)
    return latest_per_key(rows, ["vendor", "axis_id"], [F.col("created_at"), F.col("revision_id")])


def approvals_at(asks: DataFrame, revisions: DataFrame, slot_seconds: int = 86_400) -> DataFrame:
    """Each ask (vendor, axis_id, created_at) with ``approved``, the readable approval of its cell that stood at that instant
    (revision_id, signal_id, after)."""
    after = F.from_json("after_json", "struct<level: string, note: string>")
    rows = revisions.filter("action = 'approve'").withColumn("after", after).filter(F.col("after.level").isNotNull())
    return as_of(asks, rows, ["vendor", "axis_id"], "created_at", "revision_id", ["revision_id", "signal_id", "after"], slot_seconds).withColumnRenamed("found", "approved")


def reviewed_ids(revisions: DataFrame) -> DataFrame:
    return revisions.select("vendor", "axis_id", F.col("signal_id").alias("id")).distinct()


def overlay(cells: DataFrame, approvals: DataFrame, grid: DataFrame) -> DataFrame:
    """The curated cells with approved edits laid over them; edits of unknown vendors or axes are
    ignored."""
    edits = approvals.join(grid, ["vendor", "axis_id"], "left_semi").select(
        "vendor", "axis_id", F.col("after.level").alias("_l"), F.col("after.note").alias("_n")
    )
    return cells.join(edits, ["vendor", "axis_id"], "full_outer").select(
        "vendor", "axis_id", F.coalesce("_l", "level").alias("level"), F.coalesce("_n", "note").alias("note")
    )


def corroborate(
    signals: DataFrame,
    corpus: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    k: int = 30,
    days: int = CORROBORATION_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """(verdict per signal, its corroborating items).

    signals: raw_item_id, vendor, tier, at, vector (the item's lead chunk); corpus: chunk_id, item_id,
    vendor, tier, at, vector. All corroborators are counted, and whether a primary source is among
    them is asked, in one search; the second result lists the best ``k`` of them.
    """
    q = signals.select(
        F.col("raw_item_id").alias("query_id"), F.col("raw_item_id").alias("self_item"), "vendor", "at", "vector"
    )
    some, matches = within(q, corpus.withColumn("flag", F.col("tier") == "primary"), threshold, k, group="vendor", rule="band", band_days=days)
    some = some.select("query_id", F.col("n").alias("corroborators"), "best", F.col("flagged").alias("confirmed"))
    status = (
        F.when(F.col("tier") == "primary", "primary-source")
        .when(F.coalesce("confirmed", F.lit(False)), "primary-confirmed")
        .when(F.col("corroborators") > 0, "secondary-corroborated")
        .otherwise("single-source")
    )
    verdict = (
        signals.select("raw_item_id", "tier")
        .join(some, F.col("raw_item_id") == F.col("query_id"), "left")
        .select(
            "raw_item_id", F.col("tier").alias("own_tier"), status.alias("status"),
            F.coalesce("corroborators", F.lit(0)).alias("corroborators"), "best",
        )
    )
    return verdict, matches
