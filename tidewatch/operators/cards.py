"""Battlecards: matrix edges plus recent movement, for every vendor in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import strip_citations
from tidewatch.operators.gates import cites_only
from tidewatch.operators.ranking import best_first, score
from tidewatch.operators.sequence import top_per_key


def axis_split(cells: DataFrame, axes: DataFrame, focus: str) -> DataFrame:
    """Compare the focus vendor's cell with every other vendor's, axis by axis."""
    ours = cells.filter(F.col("vendor") == focus).select(
        "axis_id", F.col("level").alias("our_level"), F.col("note").alias("our_note")
    )
    theirs = cells.filter(F.col("vendor") != focus).select(
        "axis_id", "vendor", F.col("level").alias("their_level"), F.col("note").alias("their_note")
    )
    us, them = F.col("our_level"), F.col("their_level")
    edge = (
        F.when((us == "strong") & them.isin("partial", "none"), "ours")
        .when((them == "strong") & us.isin("partial", "none", "info"), "theirs")
        .when((us == "strong") & (them == "strong"), "parity")
        .otherwise("none")
    )
    return (
        theirs.join(ours, "axis_id")
        .join(axes.select("axis_id", "axis_order", "axis_label"), "axis_id")
        .withColumn("edge", edge)
    )


def recent_signals(signals: DataFrame, now: Column, n: int = 5) -> DataFrame:
    """Each vendor's strongest current signals."""
    rows = signals.filter(F.col("vendor").isNotNull()).withColumn("score", F.round(score(now), 9))
    rows = rows.withColumn("vendor_key", F.lower("vendor"))
    return top_per_key(rows, ["vendor_key"], best_first(), n)


def _labels(edges: Column, n: int, joiner: str) -> Column:
    return F.array_join(F.transform(F.slice(edges, 1, n), lambda e: e["axis_label"]), joiner)


def _positioning(focus: str) -> Column:
    ours, theirs, parity, recent = (F.col(c) for c in ("our_strengths", "their_strengths", "parity", "recent"))
    v = F.col("vendor")
    first = F.get(recent, 0)
    move = F.when(
        F.size(recent) > 0,
        F.concat(F.lit(" Latest tracked move: "), first["summary"], F.lit(" [#"), first["id"].cast("string"), F.lit("]")),
    ).otherwise("")
    n = F.size(recent)
    basis = F.when(n == 0, F.concat(F.lit("no tracked insights for "), v, F.lit(" yet"))).otherwise(
        F.concat(n.cast("string"), F.lit(" tracked "), F.when(n == 1, "insight").otherwise("insights"))
    )
    off = F.concat(
        v, F.lit(f" isn't on the {focus} comparison matrix yet — positioning here is based on "), basis, F.lit("."), move
    )
    led = F.concat(
        F.lit("Against "), v, F.lit(f", {focus} leads on "), F.size(ours).cast("string"), F.lit(" axis"),
        F.when(F.size(ours) == 1, "").otherwise("es"),
        F.when(F.size(ours) > 0, F.concat(F.lit(" ("), _labels(ours, 3, ", "), F.lit(")"))).otherwise(""), F.lit("."),
    )
    back = F.when(
        F.size(theirs) > 0, F.concat(F.lit(" "), v, F.lit(" is strongest on "), _labels(theirs, 3, ", "), F.lit("."))
    ).otherwise(F.concat(F.lit(" "), v, F.lit(" shows no clearly differentiated axis in our matrix.")))
    uncovered = F.size(ours) + F.size(theirs) + F.size(parity) == 0
    return F.trim(F.when(uncovered, off).otherwise(F.concat(led, back, move)))


def _talking_points(focus: str) -> Column:
    ours, theirs, recent = F.col("our_strengths"), F.col("their_strengths"), F.col("recent")
    first = F.get(recent, 0)
    points = F.array(
        F.when(F.size(ours) > 0, F.concat(F.lit(f"Lead with {focus}'s edge on "), _labels(ours, 2, " and "), F.lit("."))),
        F.when(
            F.size(theirs) > 0,
            F.concat(F.lit("Prepare to counter "), "vendor", F.lit(" on "), _labels(theirs, 2, " and "), F.lit(".")),
        ),
        F.when(
            F.size(recent) > 0,
            F.concat(F.lit('Reference recent movement: "'), first["title"], F.lit('" [#'), first["id"].cast("string"), F.lit("].")),
        ),
    )
    return F.filter(points, lambda p: p.isNotNull())


def battlecards(
    signals: DataFrame, vendors: DataFrame, axes: DataFrame, cells: DataFrame, focus: str, now: Column,
    written: DataFrame | None = None,
) -> DataFrame:
    """One card per vendor that is on the matrix or in the corpus, the focus vendor excluded. The
    matrix spelling wins over the corpus spelling. ``written`` (vendor, text) holds model-written
    positioning lines, used only when every citation resolves."""
    edge = F.struct("axis_order", "axis_id", "axis_label", "our_note", "their_note")

    def side(which: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("edge") == which, edge)))

    split = axis_split(cells, axes, focus).groupBy(F.lower("vendor").alias("vendor_key")).agg(
        side("ours").alias("our_strengths"), side("theirs").alias("their_strengths"), side("parity").alias("parity")
    )
    item = F.struct("rank", "id", "title", "url", "category", "impact_score", "published_at", "summary")
    moves = recent_signals(signals, now).groupBy("vendor_key").agg(
        F.min("vendor").alias("_corpus_name"), F.array_sort(F.collect_list(item)).alias("recent")
    )
    names = vendors.select(F.lower("vendor").alias("vendor_key"), F.col("vendor").alias("_matrix_name"))
    no_edges = F.array().cast(
        "array<struct<axis_order:int,axis_id:string,axis_label:string,our_note:string,their_note:string>>"
    )
    joined = names.join(moves, "vendor_key", "full_outer").join(split, "vendor_key", "left").filter(
        F.col("vendor_key") != focus.lower()
    )
    no_moves = F.filter("recent", lambda r: F.lit(False))
    base = joined.select(
        F.coalesce("_matrix_name", "_corpus_name").alias("vendor"),
        *[F.coalesce(c, no_edges).alias(c) for c in ("our_strengths", "their_strengths", "parity")],
        F.coalesce("recent", no_moves, F.array().cast(moves.schema["recent"].dataType)).alias("recent"),
    )
    cards = base.withColumns({"talking_points": _talking_points(focus), "summary": _positioning(focus)})
    if written is None:
        return cards.withColumn("written", F.lit(False))
    said = F.trim("_text")
    live = F.coalesce((said != "") & cites_only(said, F.transform("recent", lambda r: r["id"]), need_one=False), F.lit(False))
    return (
        cards.join(written.select("vendor", F.col("text").alias("_text")), "vendor", "left")
        .withColumn("written", live)
        .withColumn("summary", F.when(F.col("written"), said).otherwise(F.col("summary")))
        .drop("_text")
    )


def staleness(cards: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals per stored card that are newer than the card. cards: vendor, generated_at; signals
    carry created_at (enrichment time) as the fallback date."""
    seen = F.coalesce("published_at", "created_at")
    rows = signals.select(F.lower("vendor").alias("_k"), seen.alias("_at"))
    counted = (
        rows.join(cards.select(F.lower("vendor").alias("_k"), "generated_at"), "_k")
        .filter("_at > generated_at")
        .groupBy("_k")
        .agg(F.count("*").alias("n"))
    )
    return cards.withColumn("_k", F.lower("vendor")).join(counted, "_k", "left").select(
        "vendor", F.coalesce("n", F.lit(0)).alias("newer_signals")
    )


def to_markdown(focus: str, generated: Column) -> Column:
    """A card as one portable Markdown text."""
    v = F.col("vendor")
    ours, theirs, recent, points = (F.col(c) for c in ("our_strengths", "their_strengths", "recent", "talking_points"))

    def lines(items: Column, fmt, empty: str | None) -> Column:
        body = F.transform(items, fmt)
        fallback = F.array(F.lit(empty)) if empty else F.array().cast("array<string>")
        return F.when(F.size(items) > 0, body).otherwise(fallback)

    def heading(text: Column, body: Column, skip: Column | None = None) -> Column:
        block = F.concat(F.array(text), body, F.array(F.lit("")))
        return block if skip is None else F.when(skip, F.array().cast("array<string>")).otherwise(block)

    day = lambda r: F.when(
        r["published_at"].isNotNull(), F.concat(F.lit(" ("), F.date_format(r["published_at"], "yyyy-MM-dd"), F.lit(")"))
    ).otherwise("")
    blocks = [
        F.array(
            F.concat(F.lit(f"# Battlecard — {focus} vs. "), v), F.lit(""),
            F.concat(F.lit("_Generated "), F.date_format(generated, "yyyy-MM-dd"), F.lit(" from tracked insights._")), F.lit(""),
        ),
        heading(F.lit("## Positioning"), F.array(strip_citations(F.col("summary")))),
        heading(
            F.lit(f"## Where {focus} wins"),
            lines(
                ours,
                lambda e: F.concat(F.lit("- **"), e["axis_label"], F.lit("** — "), e["our_note"], F.lit(" _(vs. "), e["their_note"], F.lit(")_")),
                "- No differentiated advantage in the current matrix.",
            ),
        ),
        heading(
            F.concat(F.lit("## Watch-outs ("), v, F.lit(" strengths)")),
            lines(
                theirs,
                lambda e: F.concat(F.lit("- **"), e["axis_label"], F.lit("** — "), e["their_note"]),
                "- None flagged in the current matrix.",
            ),
        ),
        heading(
            F.lit("## Talking points"),
            lines(points, lambda p: F.concat(F.lit("- "), strip_citations(p)), None),
            F.size(points) == 0,
        ),
        heading(
            F.lit("## Recent activity"),
            lines(
                recent,
                lambda r: F.concat(
                    F.lit("- **"), r["title"], F.lit("**"), day(r), F.lit(" — "), r["summary"], F.lit(" [#"), r["id"].cast("string"), F.lit("]")
                ),
                "- No tracked insights yet.",
            ),
        ),
        heading(
            F.lit("## Sources"),
            lines(
                recent,
                lambda r: F.concat(F.lit("- [#"), r["id"].cast("string"), F.lit("] ["), r["title"], F.lit("]("), r["url"], F.lit(")")),
                None,
            ),
            F.size(recent) == 0,
        ),
    ]
    return F.array_join(F.concat(*blocks), "\n")
