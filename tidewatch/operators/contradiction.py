"""Do two statements about one subject make opposing claims? Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import pinned
from tidewatch.functions.text import leading_quote

# Words that carry no subject.
STOPWORDS = (
    "a an and are as at be been but by for from had has have in into is it its of on or over so than "
    "that the their them they this to was were while will with"
).split()

# Words that negate what follows.
NEGATIONS = (
    "not no never none cannot cant wont dont doesnt didnt isnt arent wasnt werent longer"
).split()

# Opposing term groups per axis.
POLARITY = {
    "direction": [
        "raise raised raises raising increase increased increases hike hiked hikes grew grow grows".split(),
        "lower lowered lowers cut cuts decrease decreased decreases drop dropped drops reduce reduced reduces".split(),
        "flat unchanged steady stable".split(),
    ],
    "lifecycle": [
        "launch launched launches release released releases introduce introduced introduces ship shipped ships".split(),
        (
            "discontinue discontinued discontinues sunset sunsets deprecate deprecated deprecates retire retired "
            "retires cancel cancelled canceled cancels kill kills killed"
        ).split(),
    ],
    "stance": [
        "confirm confirmed confirms acknowledge acknowledged acknowledges admits admitted".split(),
        (
            "deny denied denies dispute disputed disputes refute refuted refutes reject rejected rejects retract "
            "retracted retracts"
        ).split(),
    ],
    "cost": [["free"], ["paid", "chargeable"]],
}

NEGATION_REACH = 3
MIN_SHARED = 2

_MONEY = r"[$€£]\s?(\d[\d,]*(?:\.\d+)?)"
_PERCENT = r"(?i)(\d+(?:\.\d+)?)\s?(?:%|percent(?![A-Za-z0-9_]))"
_VERSION = r"(?<![A-Za-z0-9_$€£.])v?(\d+\.\d+(?:\.\d+)?)(?![A-Za-z0-9_])"


def _stem_word(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def stem(t: Column) -> Column:
    plural = (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
    return F.when(plural, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def claim_tokens(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), "['’]", "")
    parts = F.transform(
        F.split(flat, r"[^a-z0-9%$.]+"), lambda t: F.regexp_replace(t, r"^[.$%]+|[.$%]+$", "")
    )
    return F.filter(parts, lambda t: t != "")


def content_stems(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: ~t.isin(STOPWORDS + NEGATIONS) & ~t.rlike("^[0-9]"))
    return F.array_distinct(F.transform(kept, stem))


def negated_stems(tokens: Column) -> Column:
    """Stems within reach after a negation."""
    negations = F.array(*[F.lit(n) for n in NEGATIONS])

    def under(t: Column, i: Column) -> Column:
        back = F.least(i, F.lit(NEGATION_REACH))
        window = F.slice(tokens, i - back + 1, back)
        return ~t.isin(STOPWORDS + NEGATIONS) & F.arrays_overlap(window, negations)

    hit = F.filter(tokens, under)
    return F.when(
        F.arrays_overlap(tokens, negations), F.array_distinct(F.transform(hit, stem))
    ).otherwise(F.array().cast("array<string>"))


def figures(text: Column) -> Column:
    def found(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    money = F.transform(found(_MONEY), lambda m: F.replace(m, F.lit(","), F.lit("")))
    return F.struct(
        F.array_distinct(money).alias("money"),
        F.array_distinct(found(_PERCENT)).alias("percent"),
        F.array_distinct(found(_VERSION)).alias("version"),
    )


def polarity(stems: Column) -> Column:
    """Per axis the one group a statement lands in (group number and first listed term), or null
    when it lands in none or in several."""
    axes = []
    for axis, groups in POLARITY.items():
        terms = [
            F.get(
                F.filter(
                    F.array(*[F.struct(F.lit(w).alias("w"), F.lit(_stem_word(w)).alias("s")) for w in group]),
                    lambda x: F.array_contains(stems, x["s"]),
                ),
                0,
            )["w"]
            for group in groups
        ]
        hits = F.filter(
            F.array(*[F.struct(F.lit(g).alias("group"), t.alias("term")) for g, t in enumerate(terms)]),
            lambda h: h["term"].isNotNull(),
        )
        axes.append(F.when(F.size(hits) == 1, F.get(hits, 0)).alias(axis))
    return F.struct(*axes)


def with_claim_features(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Tokenise a statement once: stems, negated stems, polarity and figures."""
    tokens = f"{prefix}_tokens"
    cut = pinned(df, {tokens: claim_tokens(F.coalesce(text, F.lit("")))})
    features = {
        f"{prefix}_stems": content_stems(F.col(tokens)),
        f"{prefix}_negated": negated_stems(F.col(tokens)),
        f"{prefix}_figures": figures(F.coalesce(text, F.lit(""))),
    }
    stemmed = pinned(cut, features).drop(tokens)
    return pinned(stemmed, {f"{prefix}_polarity": polarity(F.col(f"{prefix}_stems"))})


def contradiction_signals(a: str, b: str) -> Column:
    """Evidence strings from the features of two statements; empty when they do not oppose."""
    shared = F.array_intersect(f"{a}_stems", f"{b}_stems")
    flipped = F.get(
        F.filter(
            shared,
            lambda w: F.array_contains(f"{a}_negated", w) != F.array_contains(f"{b}_negated", w),
        ),
        0,
    )
    found = [F.when(flipped.isNotNull(), F.concat(F.lit('one side negates "'), flipped, F.lit('"')))]
    for axis in POLARITY:
        left, right = F.col(f"{a}_polarity.{axis}"), F.col(f"{b}_polarity.{axis}")
        found.append(
            F.when(
                left["group"] != right["group"],
                F.concat(F.lit('opposing terms: "'), left["term"], F.lit('" vs "'), right["term"], F.lit('"')),
            )
        )
    for kind, label in (("money", "amounts"), ("percent", "percentages"), ("version", "versions")):
        left, right = F.col(f"{a}_figures.{kind}"), F.col(f"{b}_figures.{kind}")
        apart = (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)
        found.append(
            F.when(
                apart,
                F.concat(F.lit(f"{label} differ: "), F.array_join(left, ", "), F.lit(" vs "), F.array_join(right, ", ")),
            )
        )
    signals = F.filter(F.array(*found), lambda s: s.isNotNull())
    return F.when(F.size(shared) >= MIN_SHARED, signals).otherwise(F.array().cast("array<string>"))


def detect(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``contradicts`` and ``signals`` for two text columns."""
    featured = with_claim_features(with_claim_features(df, a, "_a"), b, "_b")
    out = pinned(featured, {"signals": contradiction_signals("_a", "_b")})
    drop = [c for c in out.columns if c.startswith(("_a_", "_b_"))]
    return out.withColumn("contradicts", F.size("signals") > 0).drop(*drop)


def decide(df: DataFrame, a: str, b: str, judged: str) -> DataFrame:
    """Prefer a validated judge verdict; fall back to the lexical measures."""
    return detect(df, a, b).withColumn("contradicts", F.coalesce(F.col(judged), F.col("contradicts")))


# Fixed value: the note of a conflict found by structure, around the signals it rests on.
CONFLICT_NOTE = ("These sources make opposing claims (", "); both are shown rather than assuming the newer one is settled.")


def structural_conflicts(events: DataFrame, facts: DataFrame, items: DataFrame) -> DataFrame:
    """Updates whose prior fact's item is in the same brief and whose accounts oppose.

    items: id, title, content, summary (a brief's handful). events: trigger_item_id, vendor,
    dimension, kind, before, after, previous_fact_id, status.
    """
    now = items.select(F.col("id").alias("trigger_item_id"), leading_quote(F.col("title"), F.col("content")).alias("now_quote"))
    then = items.select(
        F.col("id").alias("prior_id"),
        F.col("summary").alias("prior_summary"),
        leading_quote(F.col("title"), F.col("content")).alias("then_quote"),
    )
    evidence = facts.select(F.col("fact_id").alias("previous_fact_id"), F.col("evidence_item_id").alias("prior_id"))
    paired = (
        events.filter("kind = 'update' and status = 'ok' and previous_fact_id is not null")
        .join(now, "trigger_item_id")
        .join(evidence, "previous_fact_id")
        .filter("prior_id <> trigger_item_id")
        .join(then, "prior_id")
        .withColumn("then_text", F.coalesce("before", "prior_summary"))
    )
    side = lambda text, source, quote: F.struct(
        F.col(text).alias("text"), F.col(source).cast("bigint").alias("sourceId"), F.col(quote).alias("quote")
    )
    return (
        detect(paired, "after", "then_text")
        .filter("contradicts")
        .select(
            "trigger_item_id",
            F.concat_ws(" — ", "vendor", "dimension").alias("topic"),
            F.array(side("after", "trigger_item_id", "now_quote"), side("then_text", "prior_id", "then_quote")).alias("sides"),
            F.concat(
                F.lit(CONFLICT_NOTE[0]),
                F.array_join("signals", "; "),
                F.lit(CONFLICT_NOTE[1]),
            ).alias("note"),
        )
    )


def opposing_conflicts(conflicts: DataFrame, key: str = "conflict_id") -> DataFrame:
    """Keep drafted conflicts where any two sides contradict. The sides of one conflict are a
    handful written by hand or model, so pairing them is bounded by the conflict itself."""
    sides = conflicts.select(key, F.posexplode("sides").alias("i", "side")).select(key, "i", F.col("side.text").alias("text"))
    left, right = sides.alias("l"), sides.alias("r")
    pairs = left.join(right, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.i") < F.col("r.i"))).select(
        F.col(f"l.{key}").alias(key), F.col("l.text").alias("a"), F.col("r.text").alias("b")
    )
    firing = detect(pairs, "a", "b").filter("contradicts").select(key).distinct()
    return conflicts.join(firing, key, "left_semi")


def merge_conflicts(structural: DataFrame, drafted: DataFrame) -> DataFrame:
    """One conflict per topic, compared case-insensitively; drafted ones win, then the later."""
    columns = ["position", "topic", "sides", "note"]
    every = structural.select(*columns).withColumn("_from", F.lit(0)).unionByName(
        drafted.select(*columns).withColumn("_from", F.lit(1))
    )
    return (
        every.groupBy(F.lower("topic").alias("_t"))
        .agg(F.max_by(F.struct("topic", "sides", "note"), F.struct("_from", "position")).alias("c"))
        .select("c.*")
    )


def conflicts_containing(conflicts: DataFrame, item: Column) -> DataFrame:
    return conflicts.filter(F.exists("sides", lambda s: s["sourceId"] == item))
