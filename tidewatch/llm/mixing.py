"""Mixing sources to target weights by Pareto order sampling.

A source's target is met in two steps. Every document first gets the whole copies its expected count holds for certain.
What is left of the target is filled by Pareto order sampling: each document draws a uniform number, its rank is its
random odds divided by its inclusion odds, and the lowest ranks are taken until the words run out. The words of a sample
are fixed to within a document; the gap the last one leaves is filled by further passes over documents that still fit,
until a pass finds none.
Draws come from a hash of the document, so reruns agree.

Only expressions of DataFrames are used. What moves is one small row per document; the decision comes down to a few
thresholds per source, so texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, whole

MAX_COPIES = 3
WEIGHTS = (5, 2, 1)
SLICES = 4_096  # parts of a source's rank order that are added up on their own
BROADCAST_SOURCES = 50_000  # above this many sources their thresholds are joined by shuffle
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def draw(id_col: str, text_col: str) -> Column:
    """A uniform number in (0, 1) that depends on the document alone."""
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(whole(text_col)))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds; smaller comes first, no odds come last."""
    return F.when((inclusion > 0) & (inclusion < 1), (u / (1 - u)) / (inclusion / (1 - inclusion))).when(inclusion >= 1, F.lit(-1.0)).otherwise(F.lit(float("inf")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; no target passes
    max_copies times its source, and the excess goes to the others by weight until none is above. Sources fill up in
    the order of ceiling per weight, so one running sum over that order finds the level.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)) + 1)).withColumn("ceiling", (F.col("source_size") * max_copies).cast("double"))
    order = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    # The first source that its level does not fill sets the level of all after it.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return levels.withColumn("common", level).select("source", "source_size", F.coalesce(F.least("ceiling", F.col("common") * F.col("w")), F.col("ceiling")).alias("target"))


def _with_sources(df: DataFrame, per_source: DataFrame) -> DataFrame:
    per = per_source.withColumnRenamed("source", "_source")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    return df.join(per, df["source"].eqNullSafe(per["_source"]), "left").drop("_source")


def _expected(df: DataFrame, max_copies: int) -> DataFrame:
    """Certain copies and the inclusion odds of one more, from target, source_size, importance and the source's load."""
    rate = F.when(F.col("load") > 0, F.col("target") * F.col("importance") / F.col("load")).otherwise(F.lit(0.0))
    count = F.least(rate, F.lit(float(max_copies)))
    return df.withColumn("copies", F.floor(count)).withColumn("rank", F.when((F.col("size") > 0) & (F.col("copies") < max_copies), pareto_rank(F.col("u"), count - F.floor(count))).otherwise(F.lit(float("inf"))))


def _cuts(rows: DataFrame, gaps: DataFrame, n: int) -> DataFrame:
    """For each source the largest rank taken and the words taken, when documents that fit the gap go in rank order.

    rows: (source, rank, size); gaps: (source, gap). The rank order of a source is cut into n slices. Their sums tell
    which slices are taken whole; only the one in which the gap closes, one part in n of the source, is added up row by row.
    """
    order = F.greatest(F.col("rank"), F.lit(0.0))
    fit = _with_sources(rows, gaps).where((F.col("size") <= F.col("gap")) & (F.col("rank") < float("inf"))).withColumn("slice", F.floor(order / (1 + order) * n).cast("int"))
    sums = fit.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.max("rank").alias("top"))
    slices = stored(
        _with_sources(sums.withColumn("through", F.sum("words").over(Window.partitionBy("source").orderBy("slice"))), gaps).select("source", "slice", "top", "gap", "through", (F.col("through") - F.col("words")).alias("ahead")),
        "slices",
    )
    whole_slices = slices.where("through <= gap").select("source", F.col("top").alias("rank"), "through")
    closing = stored(slices.where("ahead <= gap and through > gap").select("source", F.col("slice").alias("closing"), "ahead"), "closing")
    inside = _with_sources(fit, closing).where("slice = closing").withColumn("through", F.col("ahead") + F.sum("size").over(Window.partitionBy("source", "slice").orderBy("rank")))
    within = inside.where("through <= gap").select("source", "rank", "through")
    return stored(whole_slices.unionByName(within).groupBy("source").agg(F.max("rank").alias("cut"), F.max("through").alias("words")), "cuts")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, slices: int = SLICES) -> tuple[DataFrame, int]:
    """(per source: source_size, target, load, and for every pass the gap before it and the rank at which it ends; passes).

    rows: (source, size, u, importance), read several times, so hand in a written table. A pass takes at least the document
    of least rank that fits, so passes end when none fits any more; each leaves less than the next document's size. Only rows
    that repeat an id and text, which share a rank and go together, may stay though one of them would fit.
    """
    loads = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("load")), "loads")
    per = stored(_with_sources(targets(loads.select("source", "source_size"), weights, max_copies), loads.select("source", "load")), "targets")
    ranked = _expected(_with_sources(rows, per), max_copies)
    certain = stored(ranked.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("certain")), "certain")
    per = stored(_with_sources(per, certain).withColumn("gap1", F.col("target") - F.col("certain")).drop("certain"), "targets")
    open_rows = ranked.select("source", "rank", "size")
    k = 0
    while True:
        k += 1
        left = open_rows if k == 1 else _with_sources(open_rows, per.select("source", *_ends(k - 1))).where(~_taken(k - 1)).select("source", "rank", "size")
        cuts = _cuts(left, per.select("source", F.col(f"gap{k}").alias("gap")), slices)
        if cuts.isEmpty():
            return per.drop(f"gap{k}"), k - 1
        cuts = cuts.withColumnRenamed("cut", f"cut{k}")
        per = stored(_with_sources(per, cuts).withColumn(f"gap{k + 1}", F.col(f"gap{k}") - F.coalesce("words", F.lit(0))).drop("words"), "targets")


def _ends(passes: int) -> list[str]:
    return [name for k in range(1, passes + 1) for name in (f"gap{k}", f"cut{k}")]


def _taken(passes: int) -> Column:
    """Whether one of the passes took the document: it fitted the gap then, and its rank lies within the cut."""
    if not passes:
        return F.lit(False)
    parts = [F.coalesce((F.col("size") <= F.col(f"gap{k}")) & (F.col("rank") <= F.col(f"cut{k}")), F.lit(False)) for k in range(1, passes + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out & (F.col("rank") < float("inf"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance_col: str | None = None) -> DataFrame:
    """The small row per document that mixing works on: source, size, u, importance."""
    importance = F.lit(1.0) if importance_col is None else F.greatest(F.coalesce(F.col(importance_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), draw(id_col, text_col).alias("u"), importance.alias("importance"))


def apply_plan(rows: DataFrame, per: DataFrame, passes: int, max_copies: int = MAX_COPIES) -> DataFrame:
    """`rows` with their source's size and target, and n_copies: how often the mix holds the document."""
    joined = _expected(_with_sources(rows, per), max_copies)
    return joined.withColumn("n_copies", (F.col("copies") + _taken(passes).cast("long")).cast("long")).drop("copies", "rank", "load", *_ends(passes))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, importance_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, n_copies, taken = n_copies * size.

    Every document of a source is expected target / source_size times (in proportion to `importance_col` if given,
    negatives and nulls as 0), at most max_copies times. Null and empty texts have size 0 and no copies beyond the
    certain ones. Documents without a source form a source of their own, last in order. Rows that repeat an id and text
    draw the same number and are taken or left together. An empty table gives an empty result.
    """
    rows = stored(measured(docs, id_col, text_col, source_col, importance_col), "sizes")
    out = apply_plan(rows, *plan(rows, weights, max_copies), max_copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("n_copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: every document of `docs`, whole and with its own columns, as often as the mix holds it.

    The thresholds per source are applied while the documents are read, so no text is shuffled.
    """
    per, passes = plan(stored(measured(docs, id_col, text_col, source_col), "sizes"), weights, max_copies)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    work = docs.select(row, F.col(source_col).alias("source"), size_of(text_col).alias("size"), draw(id_col, text_col).alias("u"), F.lit(1.0).alias("importance"))
    counted = apply_plan(work, per, passes, max_copies)
    return counted.where("n_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("_row.*")
