"""Read models: the ranked spine, feeds, facets, rosters, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import date_label, recency_weight, resolve_vendor, source_tier
from tidewatch.functions.text import leading_quote, let, significant_terms, slug, snippet
from tidewatch.operators.sequence import top_per_key
from tidewatch.session import settle
from tidewatch.schemas import (
    ALERT_IMPACT,
    BRIEF_ITEMS,
    RECENCY_HALF_LIFE_DAYS,
    RELEVANCE_SHARE,
    UNDATED_AGE_DAYS,
)

FRONT_ROWS = 10_000  # a page that ends by this row is read off a top-k


def spine(enriched: DataFrame, raw: DataFrame, sources: DataFrame, *extra: str) -> DataFrame:
    """Shown signals: enriched rows with their item and source, vendor and tier resolved.
    enriched: raw_item_id, vendors, category, impact_score, summary, why_it_matters, status."""
    s = sources.select(
        "source_id", F.col("name").alias("source_name"), F.col("kind").alias("source_kind"),
        F.col("vendor").alias("source_vendor"),
    )
    vendor = resolve_vendor(F.col("vendors"), F.col("source_vendor"))
    return (
        enriched.filter("status = 'ok'")
        .join(raw, "raw_item_id")
        .join(s, "source_id")
        .withColumn("vendor", vendor)
        .withColumn("tier", source_tier(F.col("source_kind"), F.col("source_vendor"), F.col("vendor")))
        .select(
            F.col("raw_item_id").alias("id"), "title", "url", "vendor", "category", "impact_score", "summary",
            "why_it_matters", "published_at", "source_name", "source_kind", "source_vendor", "tier", *extra,
        )
    )


DETAIL_COLUMNS = ["vendors", "products", "rationale", "created_at", "model", "prompt_version", "content", "author"]


def signal_detail(enriched: DataFrame, raw: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Shown signals with their full text, parsed lists and how they were made. ids: id."""
    wanted = ids.select(F.col("id").alias("raw_item_id"))
    return spine(enriched.join(wanted, "raw_item_id", "left_semi"), raw, sources, *DETAIL_COLUMNS)


def brief_on(briefs: DataFrame, day: Column) -> DataFrame:
    return briefs.filter(F.col("brief_date") == day)


def latest_brief(briefs: DataFrame) -> DataFrame:
    """The newest stored brief; briefs are unique by brief_date."""
    return briefs.orderBy(F.desc("brief_date")).limit(1)


def score(now: Column) -> Column:
    """Impact scaled by recency."""
    return F.col("impact_score") * recency_weight(
        F.col("published_at"), now, RECENCY_HALF_LIFE_DAYS, UNDATED_AGE_DAYS
    )


def best_first() -> list[Column]:
    return [F.desc("score"), F.desc_nulls_last("published_at"), F.desc("id")]


def ranked(signals: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    out = signals.withColumn("score", F.round(score(now), 9)).orderBy(*best_first())
    return out.limit(limit) if limit else out


def brief_items(signals: DataFrame, now: Column, top_n: int = BRIEF_ITEMS) -> DataFrame:
    """The brief's top signals with their position; a top-n, so one small ordered result."""
    best = signals.withColumn("score", F.round(score(now), 9)).orderBy(*best_first()).limit(top_n)
    row = F.struct("score", "published_at", "id", *[c for c in best.columns if c not in ("score", "published_at", "id")])
    ordered = best.agg(F.reverse(F.array_sort(F.collect_list(row))).alias("_r"))
    return ordered.select(F.posexplode("_r").alias("position", "r")).select(
        (F.col("position") + 1).alias("position"), "r.*"
    ).withColumn("score", F.round("score", 3))


def extractive_summary(items: DataFrame, empty: str = "No insights yet.") -> DataFrame:
    """Count line, high-impact count and the three best summaries with citations."""
    cited = F.concat("summary", F.lit(" [#"), F.col("id").cast("string"), F.lit("]"))
    best = F.array_sort(F.collect_list(F.when(F.col("position") <= 3, F.struct("position", cited.alias("t")))))
    n, high = F.col("n"), F.col("high")
    lead = F.concat(
        n.cast("string"), F.when(n == 1, " insight").otherwise(" insights"), F.lit(" in today's brief"),
        F.when(high > 0, F.concat(F.lit(", "), high.cast("string"), F.lit(" at impact 4 or higher."))).otherwise("."),
    )
    return items.agg(
        F.count("*").alias("n"), F.count_if(F.col("impact_score") >= 4).alias("high"), best.alias("best")
    ).select(
        F.when(n == 0, F.lit(empty))
        .otherwise(F.trim(F.concat(lead, F.lit(" "), F.array_join(F.transform("best", lambda b: b["t"]), " "))))
        .alias("summary")
    )


def extractive_claims(items: DataFrame) -> DataFrame:
    return items.filter("position <= 3").select(
        "position", F.col("summary").alias("text"), F.col("id").alias("source_id"),
        leading_quote(F.col("title"), F.col("content")).alias("quote"),
    )


def decorate_brief(items: DataFrame, material: DataFrame, verdicts: DataFrame, claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per brief item: material change flag, corroboration status, distinct quotes, conflict flag."""
    quotes = claims.groupBy(F.col("source_id").alias("id")).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "quote"))), lambda q: q["quote"])).alias("quotes")
    )
    contested = conflicts.select(F.explode("sides").alias("s")).select(F.col("s.sourceId").alias("id")).distinct()
    return (
        items.join(material.select(F.col("trigger_item_id").alias("id"), F.lit(True).alias("_m")), "id", "left")
        .join(verdicts.select(F.col("raw_item_id").alias("id"), F.col("status").alias("corroboration")), "id", "left")
        .join(quotes, "id", "left")
        .join(contested.withColumn("_c", F.lit(True)), "id", "left")
        .withColumns(
            {
                "state_change": F.coalesce("_m", F.lit(False)),
                "contested": F.coalesce("_c", F.lit(False)),
                "quotes": F.coalesce("quotes", F.array().cast("array<string>")),
            }
        )
        .drop("_m", "_c")
    )


def material_changes(events: DataFrame, ids: DataFrame, floor: int = ALERT_IMPACT) -> DataFrame:
    return (
        events.filter((F.col("status") == "ok") & F.col("kind").isin("new", "update") & (F.col("materiality") >= floor))
        .join(ids.select(F.col("id").alias("trigger_item_id")), "trigger_item_id", "left_semi")
        .select("trigger_item_id")
        .distinct()
    )


def matches_text(term: str, columns: list[str]) -> Column:
    """LIKE over several columns: ``%`` and ``_`` typed by the user stay wild."""
    pattern = f"%{term.strip()}%"
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return hit


SIGNAL_TEXT = ["title", "summary", "why_it_matters"]
CHANGE_TEXT = ["vendor", "before", "after", "rationale", "trigger_title"]


def filter_signals(
    signals: DataFrame,
    search: str | None = None,
    vendor: str | None = None,
    impact_min: int | None = None,
    include_market: bool = False,
) -> DataFrame:
    out = signals
    if search and search.strip():
        out = out.filter(matches_text(search, SIGNAL_TEXT))
    if vendor:
        out = out.filter(F.lower("vendor") == vendor.lower())
    elif not include_market:
        out = out.filter(F.col("vendor").isNotNull())
    if impact_min:
        out = out.filter(F.col("impact_score") >= impact_min)
    return out


def feed_order(sort: str = "published", direction: str = "desc") -> list[Column]:
    column = {"published": "published_at", "impact": "impact_score", "title": "title", "materiality": "materiality"}[sort]
    first = F.asc_nulls_first(column) if direction == "asc" else F.desc_nulls_last(column)
    return [first, F.desc("id")]


def page_counters(total: Column, page: int, size: int) -> list[Column]:
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")
    current = F.least(F.lit(max(1, page)), pages)
    start = (current - 1) * size
    shown = F.greatest(F.lit(0), F.least(total - start, F.lit(size)))
    return [
        total.alias("total"), pages.alias("total_pages"), current.alias("page"),
        F.when(total == 0, 0).otherwise(start + 1).alias("from_row"), (start + shown).alias("to_row"),
    ]


def paginate(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered result with its counters on every row. A page past the end clamps to
    the last one. Pages near the front are the tail of a short top-k; for any other page the rows are
    dealt into ranges of the order once, and only the ranges that hold the page are ordered."""
    total = rows.count()
    pages = max(1, -(-total // size))
    current = min(max(1, page), pages)
    start = (current - 1) * size
    if start + size <= FRONT_ROWS:
        shown = rows.orderBy(*order).limit(start + size).withColumn("_at", F.row_number().over(Window.orderBy(*order))).filter(F.col("_at") > start).drop("_at")
    else:
        shown = _slice(rows, order, start, size)
    return shown.select("*", *page_counters(F.lit(total), page, size))


def _slice(rows: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """Rows start + 1 to start + size of the order. One count per range comes to the driver."""
    ranged = settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ahead, wanted = 0, {}
    for part, n in sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()):
        if ahead < start + size and ahead + n > start:
            wanted[part] = ahead
        ahead += n
    base = F.create_map(*[F.lit(x) for item in wanted.items() for x in item]) if wanted else F.create_map(F.lit(-1), F.lit(0))
    w = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.filter(F.col("_part").isin(list(wanted))).withColumn("_at", F.row_number().over(w) + F.element_at(base, F.col("_part")))
    return placed.filter((F.col("_at") > start) & (F.col("_at") <= start + size)).orderBy("_at").select(*rows.columns)


def category_facet(signals: DataFrame) -> DataFrame:
    return signals.groupBy("category").agg(F.count("*").alias("count"))


def filter_changes(
    changes: DataFrame,
    search: str | None = None,
    vendor: str | None = None,
    dimension: str | None = None,
    kinds: list[str] | None = None,
) -> DataFrame:
    """Shown change events; the vendor filter is case-sensitive here."""
    out = changes.filter("status = 'ok'")
    if vendor:
        out = out.filter(F.col("vendor") == vendor)
    if dimension:
        out = out.filter(F.col("dimension") == dimension)
    if kinds:
        out = out.filter(F.col("kind").isin(kinds))
    if search and search.strip():
        out = out.filter(matches_text(search, CHANGE_TEXT))
    return out


def with_trigger(events: DataFrame, raw: DataFrame) -> DataFrame:
    item = raw.select(
        F.col("raw_item_id").alias("trigger_item_id"), F.col("title").alias("trigger_title"),
        F.col("url").alias("trigger_url"), "published_at",
    )
    return events.join(item, "trigger_item_id")


def tracked(signals: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose vendor's slug is in the configured set."""
    slugs = names.select(slug(F.col("vendor")).alias("_slug")).distinct()
    return signals.withColumn("_slug", slug(F.col("vendor"))).join(slugs, "_slug", "left_semi").drop("_slug")


def vendor_roster(signals: DataFrame) -> DataFrame:
    """Per vendor: count, newest signal, strongest impact, categories by frequency. One shuffle:
    counts per (vendor, category) first, then folded per vendor (five categories at most)."""
    newest = F.struct("published_at", "id")
    per = signals.filter(F.col("vendor").isNotNull()).groupBy("vendor", "category").agg(
        F.count("*").alias("n"), F.max("impact_score").alias("impact"), F.max(newest).alias("newest"),
        F.max_by("title", newest).alias("title"),
    )
    by_use = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category")))
    return per.groupBy("vendor").agg(
        F.sum("n").alias("signal_count"),
        F.max("newest")["published_at"].alias("latest_at"),
        F.max_by("title", "newest").alias("latest_title"),
        F.max("impact").alias("max_impact"),
        F.transform(by_use, lambda c: c["category"]).alias("categories"),
    ).withColumn("slug", slug(F.col("vendor")))


def companies(matrix_vendors: DataFrame, roster: DataFrame, focus: str) -> DataFrame:
    """Matrix columns first, then roster vendors not present by slug; the focus vendor excluded."""
    curated = matrix_vendors.filter(F.lower("vendor") != focus.lower()).select("vendor", "slug", F.lit(True).alias("on_matrix"))
    others = roster.filter(F.lower("vendor") != focus.lower()).select("vendor", "slug", F.lit(False).alias("on_matrix"))
    extra = others.join(curated.select("slug"), "slug", "left_anti").groupBy("slug").agg(F.min("vendor").alias("vendor"))
    return curated.unionByName(extra.withColumn("on_matrix", F.lit(False)))


def related(signals: DataFrame, focus: DataFrame, limit: int = 5) -> DataFrame:
    """Newest other signals of the same vendor for every focus signal (focus_id, vendor).

    The newest ``limit + 1`` signals of a vendor answer for all of its focus rows, so the vendor's
    history is cut to a constant before the join.
    """
    vendor = F.lower("vendor")
    newest = top_per_key(
        signals.filter(F.col("vendor").isNotNull()).withColumn("_v", vendor), ["_v"],
        [F.desc_nulls_last("published_at"), F.desc("id")], limit + 1, "_n",
    ).select("_v", "id", "title", "published_at", "_n")
    pairs = focus.select("focus_id", vendor.alias("_v")).join(newest, "_v").filter("id <> focus_id")
    return top_per_key(pairs, ["focus_id"], [F.col("_n")], limit).drop("_v", "_n")


def timeline(signals: DataFrame) -> DataFrame:
    """Per vendor and day: label, count, newest and oldest row. Rows of a day are contiguous in a
    newest-first list, so grouping by day gives the runs."""
    day = F.to_date("published_at")
    newest = F.struct("published_at", "id")
    return signals.filter(F.col("vendor").isNotNull()).groupBy("vendor", day.alias("day")).agg(
        date_label(F.max("published_at")).alias("label"), F.count("*").alias("n"),
        F.max(newest)["id"].alias("first_id"), F.min(newest)["id"].alias("last_id"),
    )


def search_hits(
    term: str, signals: DataFrame, roster: DataFrame, cards: DataFrame, changes: DataFrame, axes: DataFrame, per_group: int = 5
) -> DataFrame:
    """Top hits of each entity kind in one typed frame."""
    needle = term.strip().lower()
    none = F.lit(None).cast("string")
    hits = [
        signals.filter(matches_text(term, SIGNAL_TEXT)).select(
            F.lit("insight").alias("type"), F.col("id").cast("string").alias("key"), "title",
            snippet(F.col("summary")).alias("snippet"), F.col("vendor").alias("meta"),
            F.struct(F.coalesce(-F.unix_micros("published_at"), F.lit(2**62)).alias("o"), (-F.col("id")).alias("i")).alias("_o"),
        ),
        roster.filter(F.lower("vendor").contains(needle)).select(
            F.lit("competitor").alias("type"), F.col("slug").alias("key"), F.col("vendor").alias("title"),
            snippet(F.col("latest_title")).alias("snippet"),
            F.concat(F.col("signal_count").cast("string"), F.when(F.col("signal_count") == 1, " insight").otherwise(" insights")).alias("meta"),
            F.struct((-F.col("signal_count")).alias("o"), F.coalesce(-F.unix_micros("latest_at"), F.lit(0)).alias("i")).alias("_o"),
        ),
        cards.filter(F.lower("vendor").contains(needle)).select(
            F.lit("battlecard").alias("type"), F.col("slug").alias("key"), F.concat("vendor", F.lit(" battlecard")).alias("title"),
            F.concat(F.lit("How we compare against "), "vendor", F.lit(".")).alias("snippet"), none.alias("meta"),
            F.struct(F.when(F.col("on_matrix"), 0).otherwise(1).cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("i")).alias("_o"),
        ),
        changes.filter(matches_text(term, CHANGE_TEXT)).select(
            F.lit("change").alias("type"), F.col("id").cast("string").alias("key"),
            F.concat_ws(" — ", "vendor", "dimension").alias("title"), snippet(F.col("after")).alias("snippet"), F.col("kind").alias("meta"),
            F.struct(F.coalesce(-F.unix_micros("published_at"), F.lit(2**62)).alias("o"), (-F.col("id")).alias("i")).alias("_o"),
        ),
        axes.filter(F.lower("axis_label").contains(needle) | F.lower("description").contains(needle)).select(
            F.lit("matrix").alias("type"), F.col("axis_id").alias("key"), F.col("axis_label").alias("title"),
            snippet(F.col("description")).alias("snippet"), none.alias("meta"),
            F.struct(F.col("axis_order").cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("i")).alias("_o"),
        ),
    ]
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    return top_per_key(every, ["type"], [F.col("_o"), F.col("key")], per_group).drop("_o")


def page_verdict(text: Column, title: Column, vendor: Column, max_chars: int | None = None) -> Column:
    """Does a fetched page carry the item? Vendor named (if any) and half the title terms. The whole
    page is read unless ``max_chars`` bounds the scan."""
    page = text if max_chars is None else F.substring(text, 1, max_chars)
    return F.when(text.isNull(), "unreachable").otherwise(let(F.lower(page), lambda hay: _carried(hay, title, vendor)))


def _carried(hay: Column, title: Column, vendor: Column) -> Column:
    names, terms = significant_terms(vendor), significant_terms(title)
    vendor_ok = (F.coalesce(vendor, F.lit("")) == "") | (F.size(names) == 0) | F.exists(names, lambda t: hay.contains(t))
    share = F.size(F.filter(terms, lambda t: hay.contains(t))) / F.size(terms)
    title_ok = (F.size(terms) == 0) | (F.when(F.size(terms) > 0, share) >= RELEVANCE_SHARE)
    return F.when(vendor_ok & title_ok, "verified").otherwise("irrelevant")


def alert_rows(items: DataFrame, floor: int = ALERT_IMPACT) -> DataFrame:
    """High-impact brief items with the line that stands in for a bad link."""
    link = (
        F.when(F.col("url_status") == "unreachable", F.concat(F.lit("⚠ source link unreachable, not linked ("), "url", F.lit(")")))
        .when(
            F.col("url_status") == "irrelevant",
            F.concat(F.lit("⚠ source link did not resolve to a relevant page, not linked ("), "url", F.lit(")")),
        )
        .otherwise(F.col("url"))
    )
    headline = F.concat(
        F.lit("[impact "), F.col("impact_score").cast("string"), F.lit("] "), "title",
        F.when(F.coalesce("vendor", F.lit("")) != "", F.concat(F.lit(" — "), "vendor")).otherwise(""),
    )
    return items.filter(F.col("impact_score") >= floor).select("id", headline.alias("headline"), "why_it_matters", link.alias("link"))
