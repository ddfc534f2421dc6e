"""What changed: sentence diffs, classification against priors, fact chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import pinned
from tidewatch.functions.labels import dimension_of
from tidewatch.functions.text import fold, let, sentences, trim_all
from tidewatch.functions.vectors import dot
from tidewatch.operators.neighbours import nearest
from tidewatch.operators.sequence import as_of, top_per_key, with_neighbours
from tidewatch.schemas import SIMILARITY_THRESHOLD

MARKET = "Market"


def sentence_diff(before: Column, after: Column) -> Column:
    """Sentences only in ``before`` (removed) and only in ``after`` (added), verbatim, in order.
    A null text has no sentences."""
    folded = lambda side: F.transform(side, fold)

    def keyed(s: Column) -> Column:
        """Each side is split and folded once; the keys only one side has come from a hash set."""
        return F.struct(s["old"].alias("old"), s["new"].alias("new"), folded(s["old"]).alias("old_keys"), folded(s["new"]).alias("new_keys"))

    def gone(k: Column) -> Column:
        return F.struct(k, F.array_except(k["old_keys"], k["new_keys"]).alias("removed"), F.array_except(k["new_keys"], k["old_keys"]).alias("added"))

    def pick(these: Column, keys: Column, only: Column) -> Column:
        # No key of its own, or nothing but such keys: no look-up needed.
        hits = F.filter(these, lambda s, i: F.array_contains(only, F.get(keys, i)))
        return F.when(F.size(only) == 0, F.slice(these, 1, 0)).when(F.size(only) == F.size(F.array_distinct(keys)), these).otherwise(hits)

    def differing(g: Column) -> Column:
        k = g["k"]
        return F.struct(pick(k["old"], k["old_keys"], g["removed"]).alias("removed"), pick(k["new"], k["new_keys"], g["added"]).alias("added"))

    both = F.struct(sentences(F.coalesce(before, F.lit(""))).alias("old"), sentences(F.coalesce(after, F.lit(""))).alias("new"))
    return let(let(let(both, keyed), lambda k: gone(k.alias("k"))), differing)


def classify_revisions(revised: DataFrame) -> DataFrame:
    """Diff revised items against their stored pre-image. Needs raw_item_id, title, content,
    summary, impact_score, category, source_kind, previous_title, previous_content."""
    d = pinned(revised, {"_d": sentence_diff(F.col("previous_content"), F.col("content"))})
    removed, added = F.col("_d.removed"), F.col("_d.added")
    retitled = trim_all(F.col("previous_title")) != trim_all(F.col("title"))
    before = F.when(F.size(removed) > 0, F.array_join(removed, " ")).when(retitled, F.col("previous_title"))
    after = (
        F.when(F.size(added) > 0, F.array_join(added, " ")).when(retitled, F.col("title")).otherwise(F.col("summary"))
    )
    same = (F.coalesce(before, F.lit("")) == "") & (F.size(added) == 0)
    none = F.array().cast("array<bigint>")
    rationale = F.concat(
        F.lit("Source revised the item: "), F.size(removed).cast("string"), F.lit(" sentence(s) removed, "),
        F.size(added).cast("string"), F.lit(" added."),
    )
    return d.withColumns(
        {
            "kind": F.when(same, "duplicate").otherwise("update"),
            "dimension": dimension_of(F.col("category"), F.col("source_kind")),
            "before": F.when(~same, before),
            "after": F.when(same, F.col("summary")).otherwise(after),
            "materiality": F.when(same, 1).otherwise(F.col("impact_score")),
            "rationale": F.when(same, "Republished with no sentence-level changes.").otherwise(rationale),
            "evidence": F.when(same, none).otherwise(F.array(F.col("raw_item_id").cast("bigint"))),
        }
    ).drop("_d")


def similar_priors(
    triggers: DataFrame, corpus: DataFrame, k: int = 5, candidate_k: int | None = None
) -> DataFrame:
    """Older items of the same vendor by best-chunk similarity: query_id, item_id, similarity, rank.

    triggers: query_id, self_item, vendor, at, vector; corpus: chunk_id, item_id, vendor, at, vector.
    By default the search runs inside the vendor's own history. ``candidate_k`` takes that many
    neighbours of the whole index first and filters afterwards, which can starve a rare vendor.
    """
    if candidate_k is None:
        return nearest(triggers, corpus, k, group="vendor", rule="earlier", by_item=True)
    meta = corpus.select("chunk_id", F.lower("vendor").alias("_cv"), F.col("at").alias("_cat"))
    own = triggers.select("query_id", "self_item", F.lower("vendor").alias("_qv"), F.col("at").alias("_qat"))
    wide = nearest(triggers.drop("self_item"), corpus, candidate_k)
    kept = (
        wide.drop("rank", "distance")
        .join(meta, "chunk_id")
        .join(own, "query_id")
        .filter("item_id <> self_item and _cv = _qv and _cat is not null and (_qat is null or _cat < _qat)")
        .groupBy("query_id", "item_id")
        .agg(F.max("similarity").alias("similarity"))
    )
    return top_per_key(kept, ["query_id"], [F.desc("similarity"), F.col("item_id")], k)


def classify_against_priors(fresh: DataFrame, priors: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """A re-phrasing of the nearest close enough older item, else genuinely new. priors:
    raw_item_id, prior_id, similarity, prior_summary, prior_title (nearest only)."""
    d = fresh.join(priors, "raw_item_id", "left")
    close = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    score = F.format_string("%.2f", F.col("similarity"))
    pid = F.col("prior_id").cast("string")
    said = F.when(F.coalesce("prior_summary", F.lit("")) != "", F.col("prior_summary")).otherwise(F.col("prior_title"))
    rationale = (
        F.when(close, F.concat(F.lit("Similarity "), score, F.lit(" to prior item #"), pid, F.lit(f" (threshold {threshold}).")))
        .when(
            F.col("prior_id").isNotNull(),
            F.concat(F.lit("Nearest prior item #"), pid, F.lit(" at similarity "), score, F.lit(", below threshold.")),
        )
        .otherwise("No prior item for this vendor resembles it.")
    )
    none = F.array().cast("array<bigint>")
    return d.withColumns(
        {
            "kind": F.when(close, "rephrase").otherwise("new"),
            "dimension": dimension_of(F.col("category"), F.col("source_kind")),
            "before": F.when(close, said),
            "after": F.col("summary"),
            "materiality": F.when(close, 1).otherwise(F.col("impact_score")),
            "rationale": rationale,
            "evidence": F.when(close, F.array(F.col("prior_id").cast("bigint"))).otherwise(none),
        }
    ).drop("prior_summary", "prior_title")


def fact_chain(events: DataFrame, slot_seconds: int = 86_400, run_at: Column | None = None) -> DataFrame:
    """Replay dated change events into vendor facts.

    events: item_id (one event per item), vendor, dimension, kind, after, at. On a full replay every
    fact-making event is the newest of its (vendor, dimension), so an ``update`` supersedes exactly
    the fact before it. Facts: fact_id (= the evidence item), vendor, dimension, fact, valid_from,
    kind, previous_fact_id, superseded_by, superseded_at.

    Undated items hold from ``run_at``, the time of the run; without it they make no fact.
    """
    if run_at is not None:
        events = events.withColumn("at", F.coalesce("at", run_at))
    made = events.filter(
        F.col("vendor").isNotNull() & F.col("kind").isin("new", "update") & F.col("at").isNotNull()
    )
    linked = with_neighbours(made, ["vendor", "dimension"], "at", "item_id", ["kind"], slot_seconds)
    replaced = F.col("next.kind") == "update"
    return linked.select(
        F.col("item_id").alias("fact_id"),
        "vendor",
        "dimension",
        F.col("after").alias("fact"),
        F.col("at").alias("valid_from"),
        "kind",
        F.when(F.col("kind") == "update", F.col("previous.item_id")).alias("previous_fact_id"),
        F.when(replaced, F.col("next.item_id")).alias("superseded_by"),
        F.when(replaced, F.col("next.at")).alias("superseded_at"),
    )


def link_restatements(events: DataFrame, facts: DataFrame) -> DataFrame:
    """The fact a re-phrasing or duplicate points back at: the one its evidence item made, while it
    was still current. events: item_id, kind, at, evidence."""
    asked = events.filter(F.col("kind").isin("rephrase", "duplicate")).withColumn(
        "fact_id", F.get(F.filter("evidence", lambda x: x != F.col("item_id")), 0)
    )
    current = facts.select(
        "fact_id", "valid_from", F.struct("superseded_at", F.col("superseded_by").alias("by")).alias("_gone")
    )
    joined = asked.join(current, "fact_id", "left")
    mine = F.struct(F.col("at").alias("superseded_at"), F.col("item_id").alias("by"))
    made_before = F.struct("valid_from", "fact_id") < F.struct(F.col("at").alias("valid_from"), F.col("item_id").alias("fact_id"))
    alive = F.col("_gone.by").isNull() | (F.col("_gone") > mine)
    dated = F.col("valid_from").isNotNull() & F.col("at").isNotNull()
    return joined.withColumn("previous_fact_id", F.when(dated & made_before & alive, F.col("fact_id"))).drop(
        "fact_id", "valid_from", "_gone"
    )


def current_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("superseded_by").isNull())


def facts_as_of(facts: DataFrame, at: Column) -> DataFrame:
    return facts.filter(
        (F.col("valid_from") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at))
    )


def facts_at(asks: DataFrame, facts: DataFrame, slot_seconds: int = 86_400) -> DataFrame:
    """Each ask (vendor, dimension, at) with ``held``, the id of the fact that a full replay holds newest at its own instant."""
    made = facts.select("vendor", "dimension", F.col("valid_from").alias("at"), "fact_id")
    return as_of(asks, made, ["vendor", "dimension"], "at", "fact_id", ["fact_id"], slot_seconds).withColumn("held", F.col("found.fact_id")).drop("found")


def change_events(classified: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """One event per trigger item with its fact pointers; unattributed items read ``Market``."""
    made = facts.select(
        F.col("fact_id").alias("raw_item_id"), F.col("previous_fact_id").alias("_p"), F.lit(True).alias("_made")
    )
    linked = links.select(F.col("item_id").alias("raw_item_id"), F.col("previous_fact_id").alias("_l"))
    return (
        classified.join(made, "raw_item_id", "left")
        .join(linked, "raw_item_id", "left")
        .select(
            F.col("raw_item_id").alias("trigger_item_id"),
            F.coalesce("vendor", F.lit(MARKET)).alias("vendor"),
            "dimension", "kind", "before", "after", "materiality", "rationale",
            F.when(F.col("vendor").isNotNull(), F.coalesce("_p", "_l")).alias("previous_fact_id"),
            F.when(F.col("_made"), F.col("raw_item_id")).alias("new_fact_id"),
            F.lit("ok").alias("status"),
        )
    )


def kind_report(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def evaluate_pairs(pairs: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Predicted kind of labelled pairs. pairs: id, prior, next, revised, expected, prior_vector,
    next_vector."""
    pairs = pinned(pairs, {"_d": sentence_diff(F.col("prior"), F.col("next"))})
    same = (F.size("_d.removed") == 0) & (F.size("_d.added") == 0)
    similarity = dot(F.col("prior_vector"), F.col("next_vector"))
    textual = F.coalesce("revised", F.lit(False)) & F.col("prior").isNotNull()
    actual = (
        F.when(textual, F.when(same, "duplicate").otherwise("update"))
        .when(F.col("prior").isNull(), "new")
        .when(similarity >= threshold, "rephrase")
        .otherwise("new")
    )
    return pairs.withColumns(
        {
            "actual": actual,
            "similarity": F.when(~textual & F.col("prior").isNotNull(), similarity),
        }
    ).withColumn("correct", F.col("actual") == F.col("expected")).drop("_d")


def accuracy(results: DataFrame) -> DataFrame:
    right = F.count_if("correct")
    return results.agg(
        F.count("*").alias("total"),
        right.alias("correct"),
        F.when(F.count("*") == 0, F.lit(1.0)).otherwise(right / F.count("*")).alias("accuracy"),
    )


