"""Benchmark passages found in documents through a positional inverted index.

Documents are split into words once and written (row, words); the written table is what every later step reads. Of each
window of a benchmark text the two rarest words are its key: their postings (term, row, position) are written, the list
of the rarest is moved by its offset in the text, and only the places where the second's list agrees stay. What is left
is compared word by word with the document, so a phrase match is exact. The same lists, joined within a reach instead of
at a fixed offset, give proximity matches.

Awkward input: null counts as the empty text and has no words. Rows with equal or null ids are rows of their own. Benchmark
rows of one item_id count as one item, rows of one text share their postings; a null item_id is written as the empty
string. A text of fewer words than a window is one window; one without words never matches. Very long texts are
searched whole. Empty tables give empty results, or no matches. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10  # words of a window
REACH = 10  # words that the two rarest words of a window may lie apart in a proximity match


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and no other letter changed."""
    return F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """Written tables of one search: `forward` (row, doc_id, n_words, words), `postings` (term, row, pos) of the terms that
    keys use, `keys` (item, first, second, first_at, second_at, starts, stretch) and `items` (item_id, item)."""

    forward: DataFrame
    postings: DataFrame
    keys: DataFrame
    items: DataFrame


def build(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Index:
    """Index the documents' words for the windows of the benchmark.

    The frequencies behind "rarest" are counted over all documents. Only terms of keys get postings: each window is decided
    by its own two rarest words, so the lists of common words are never written unless a window has no others.
    """
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(whole(text_col)).alias("words"))
    forward = stored(split.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words"), "forward")

    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words(whole(item_text_col)).alias("words")).where(F.size("words") > 0)
    named = stored(named.withColumn("item", F.sha2(F.concat_ws(" ", "words"), 256)), "items")
    texts = named.dropDuplicates(["item"]).select("item", "words")
    places = texts.select("item", F.size("words").alias("n"), F.posexplode("words").alias("pos", "term"))

    counted = forward.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = places.select("term").distinct().join(counted, "term")
    span = F.least(F.lit(window), F.col("n"))
    seen = places.join(known, "term").select("item", "n", "pos", "term", "df", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - span + 1), F.least(F.col("pos"), F.col("n") - span))).alias("start"))
    ranked = seen.groupBy("item", "n", "start").agg(F.array_sort(F.collect_list(F.struct("df", "pos", "term"))).alias("by_rarity"))
    # A window with a word that no document has can't occur.
    ranked = ranked.where(F.size("by_rarity") == span)
    first, second = F.col("by_rarity")[0], F.coalesce(F.get("by_rarity", F.lit(1)), F.col("by_rarity")[0])
    keyed = ranked.select("item", "start", span.alias("span"), first["term"].alias("first"), first["pos"].alias("first_at"), second["term"].alias("second"), second["pos"].alias("second_at"))
    keyed = keyed.groupBy("item", "span", "first", "first_at", "second", "second_at").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    low, high = F.col("starts")[0], F.element_at("starts", -1)
    keys = stored(keyed.join(texts, "item").select("item", "span", "first", "first_at", "second", "second_at", "starts", F.slice("words", low + 1, high - low + F.col("span")).alias("stretch")), "keys")

    wanted = stored(keys.select(F.explode(F.array("first", "second")).alias("term")).distinct(), "terms")
    postings = stored(forward.select("row", F.posexplode("words").alias("pos", "term")).join(wanted, "term").select("term", "row", "pos"), "postings")
    return Index(forward, postings, keys, named.select("item_id", "item"))


def _met(index: Index) -> DataFrame:
    """Places where both words of a key stand at their offsets: the key's columns, row and `shift`, the place of the text's first word."""
    lists = index.postings
    moved = index.keys.join(lists.withColumnRenamed("term", "first"), "first").withColumn("shift", F.col("pos") - F.col("first_at")).drop("pos")
    there = lists.select(F.col("row").alias("_row"), F.col("term").alias("_term"), F.col("pos").alias("_pos"))
    return moved.join(there, (F.col("row") == F.col("_row")) & (F.col("second") == F.col("_term")) & (F.col("shift") + F.col("second_at") == F.col("_pos")), "left_semi")


def phrase_matches(index: Index) -> DataFrame:
    """Every window that occurs: (row, matches array<struct<at, till, item>>), positions of words, `till` exclusive.

    One row per document with matches. Its places are brought to its words once, however many there are. Few documents have
    any, so the words of the others are left out by their ids first, which Spark can send around while they are few.
    """
    places = stored(_met(index).groupBy("row").agg(F.collect_list(F.struct("item", "span", "shift", "starts", "stretch")).alias("places")), "places")
    touched = stored(places.select("row"), "touched")
    both = places.join(index.forward.select("row", "words").join(touched, "row", "left_semi"), "row")

    def occurs(p: Column, start: Column) -> Column:
        at = p["shift"] + start
        told = F.slice(p["stretch"], start - p["starts"][0] + 1, p["span"])
        # A place before the text's beginning holds no window; one beyond its end gives a shorter slice.
        return F.when(at >= 0, F.slice("words", F.greatest(at, F.lit(0)) + 1, p["span"]) == told).otherwise(False)

    def found(p: Column) -> Column:
        return F.transform(F.filter(p["starts"], lambda s: occurs(p, s)), lambda s: F.struct((p["shift"] + s).alias("at"), (p["shift"] + s + p["span"]).alias("till"), p["item"].alias("item")))

    matched = both.select("row", F.array_sort(F.flatten(F.transform("places", found))).alias("matches"))
    return matched.where(F.size("matches") > 0)


def proximity_matches(index: Index, reach: int = REACH) -> DataFrame:
    """(row, item) where the two rarest words of one of the text's windows lie at most `reach` words apart, in either order.

    Places are joined by stretches of `reach` words, a place with its own stretch and the ones beside it.
    """
    lists = index.postings
    pairs = index.keys.select("item", "first", "second").distinct()
    beside = F.explode(F.array(*[F.floor(F.col("pos") / reach) + d for d in (-1, 0, 1)]))
    one = pairs.join(lists.withColumnRenamed("term", "first"), "first").select("item", "second", "row", F.col("pos").alias("one"), beside.alias("tile"))
    other = lists.join(pairs.select(F.col("second").alias("term")).distinct(), "term", "left_semi").select(F.col("term").alias("second"), "row", F.col("pos").alias("other"), F.floor(F.col("pos") / reach).alias("tile"))
    close = one.join(other, ["row", "second", "tile"]).where(F.abs(F.col("one") - F.col("other")) <= reach)
    return close.select("row", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a window that occurs), n_items and item_ids (sorted
    strings, of items with such windows), near_items (items with a proximity match)."""
    index = build(docs, benchmark, **settings)
    hits = stored(
        phrase_matches(index).select(
            "row",
            F.array_distinct(F.transform("matches", lambda m: m["item"])).alias("texts"),
            # Matches are in order of their first word; each adds what lies beyond the end of those before it.
            F.aggregate(
                "matches",
                F.struct(F.lit(0).alias("till"), F.lit(0).cast("long").alias("n")),
                lambda have, m: F.struct(F.greatest(have["till"], m["till"]).alias("till"), (have["n"] + F.greatest(F.lit(0), m["till"] - F.greatest(have["till"], m["at"]))).alias("n")),
                lambda have: have["n"],
            ).alias("n_hit"),
        ),
        "hits",
    )
    by_item = lambda df: df.join(index.items, "item").groupBy("row")
    exact = by_item(hits.select("row", F.explode("texts").alias("item"))).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    near = by_item(proximity_matches(index)).agg(F.count_distinct("item_id").alias("near_items"))
    told = hits.select("row", "n_hit").join(exact, "row", "left").join(near, "row", "full_outer")
    none = F.array().cast("array<string>")
    return (
        index.forward.select("row", "doc_id", "n_words")
        .join(told, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_items", F.lit(0).cast("long")).alias("near_items"))
    )
