"""Operator inputs derived from the test tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.labels import string_array
from tidewatch.functions.text import first_sentence
from tidewatch.operators.ranking import spine
from tidewatch.session import file_size

NOW_TEXT = "2024-01-31 00:00:00"
FOCUS = "v0"
SPLIT_BYTES = 128 << 20


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    if zoneless:
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
    return spread(df) if name in ("documents", "pages", "conversations") else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core for text work when the table is one file of less than a split for each. Any other table is left as it
    is, so nothing large is ever shuffled for this."""
    files = df.inputFiles()
    if len(files) != 1:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if file_size(df.sparkSession, files[0]) < cores * SPLIT_BYTES else df


def _category(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "Security").when(event_type == "click", "Product")
        .when(event_type == "purchase", "Pricing").when(event_type == "signup", "Business").otherwise("Ecosystem")
    )


def sources(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    kind = F.when(F.col("n_regionkey") == 0, "github").when(F.col("n_regionkey") == 1, "nvd").when(
        F.col("n_regionkey") == 2, "hn"
    ).otherwise("rss")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("source_id"),
        F.col("n_name").alias("name"),
        kind.alias("kind"),
        F.when(F.col("n_regionkey") != 4, F.concat(F.lit("v"), (F.col("n_nationkey") % 10).cast("string"))).alias("vendor"),
        F.concat(F.lit("https://feeds.example.com/"), F.lower("n_name")).alias("url"),
    )


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("raw_item_id"),
        (F.col("user_id") % 25).alias("source_id"),
        F.concat(F.initcap("event_type"), F.lit(" by user "), user).alias("title"),
        F.concat(F.lit("https://example.com/e/"), F.col("event_id").cast("string")).alias("url"),
        F.when(F.col("user_id") % 23 != 0, F.col("ts")).alias("published_at"),
        F.col("ts").alias("fetched_at"),
    )


def vendors_json() -> Column:
    u = F.col("user_id")
    v = F.concat(F.lit("v"), (u % 10).cast("string"))
    return (
        F.when(u % 17 == 0, F.lit("[]")).when(u % 19 == 0, F.lit("not json"))
        .when(u % 7 == 0, F.concat(F.lit('[1, "'), v, F.lit('"]')))
        .otherwise(F.concat(F.lit('["'), v, F.lit('", "v9"]')))
    )


def enriched(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    category = _category(F.col("event_type"))
    return e.select(
        F.col("event_id").alias("raw_item_id"),
        string_array(vendors_json()).alias("vendors"),
        category.alias("category"),
        (F.floor("value") % 5 + 1).cast("int").alias("impact_score"),
        F.concat(
            F.lit("User "), F.col("user_id").cast("string"), F.lit(" logged "), "event_type", F.lit(". Payload "), "props", F.lit(".")
        ).alias("summary"),
        F.concat(F.lit("Counts toward "), category, F.lit(" coverage")).alias("why_it_matters"),
        F.when(F.col("value") < 1, "quarantined").otherwise("ok").alias("status"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("created_at"),
    )


def signals(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return spine(enriched(spark, d), raw_items(spark, d), sources(spark, d), *extra)


SOURCES_SQL = """sources AS (
  SELECT n_nationkey::BIGINT AS source_id, n_name AS name,
    CASE n_regionkey WHEN 0 THEN 'github' WHEN 1 THEN 'nvd' WHEN 2 THEN 'hn' ELSE 'rss' END AS kind,
    CASE WHEN n_regionkey <> 4 THEN 'v' || (n_nationkey % 10) END AS vendor,
    'https://feeds.example.com/' || lower(n_name) AS url
  FROM nation)"""

_CATEGORY_SQL = (
    "CASE event_type WHEN 'error' THEN 'Security' WHEN 'click' THEN 'Product' WHEN 'purchase' THEN 'Pricing' "
    "WHEN 'signup' THEN 'Business' ELSE 'Ecosystem' END"
)

SIGNALS_SQL = f"""{SOURCES_SQL},
every_signal AS (
  SELECT e.event_id AS id, upper(event_type[1]) || event_type[2:] || ' by user ' || user_id AS title,
    'https://example.com/e/' || event_id AS url,
    coalesce(CASE WHEN user_id % 17 = 0 OR user_id % 19 = 0 THEN NULL ELSE 'v' || (user_id % 10) END, s.vendor) AS vendor,
    {_CATEGORY_SQL} AS category,
    (1 + floor(value)::BIGINT % 5)::BIGINT AS impact_score,
    'User ' || user_id || ' logged ' || event_type || '. Payload ' || props || '.' AS summary,
    'Counts toward ' || {_CATEGORY_SQL} || ' coverage' AS why_it_matters,
    CASE WHEN user_id % 23 <> 0 THEN ts END AS published_at,
    ts AS fetched_at, ts + INTERVAL 1 HOUR AS created_at,
    s.source_id, s.name AS source_name, s.kind AS source_kind, s.vendor AS source_vendor,
    CASE WHEN value < 1 THEN 'quarantined' ELSE 'ok' END AS status
  FROM events e JOIN sources s ON s.source_id = e.user_id % 25),
signals AS (
  SELECT *, CASE WHEN source_kind IN ('github', 'nvd')
                   OR (source_kind = 'rss' AND lower(source_vendor) = lower(vendor)) THEN 'primary' ELSE 'secondary' END AS tier,
    impact_score * pow(0.5, (CASE WHEN published_at IS NULL THEN 30.0::DOUBLE
      ELSE greatest(0.0::DOUBLE, (epoch_us({NOW_SQL}) - epoch_us(published_at)) / 86400000000.0::DOUBLE) END) / 7.0::DOUBLE) AS raw_score
  FROM every_signal WHERE status = 'ok'),
scored AS (SELECT *, round(raw_score, 9) AS score FROM signals)"""

# Whitespace as the engine sees it, in the oracle's regular-expression syntax.
W = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"lower({sql_collapse(x)})"


def sql_sentences(x: str) -> str:
    """Sentence list of the diff form; a control character marks the breaks."""
    marked = f"regexp_replace(regexp_replace({x}, '([.!?]){W}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {sql_trim('s')}), lambda s: s <> '')"


def sql_tokens(x: str) -> str:
    return f"greatest(1, ceil(len(regexp_extract_all({x}, '[^{W[1:-1]}]+')) * 1.3::DOUBLE))::BIGINT"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as landed items. Addresses repeat inside a source, bodies repeat as copies."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("raw_item_id"),
        F.col("source").alias("source_id"),
        F.col("doc_id").alias("seq"),
        F.concat(
            F.lit("HTTPS://www.Example.com/"), "source", F.lit("/"), F.col("n_chars").cast("string"), F.lit("/?utm_source=feed&b=2&a=1#top")
        ).alias("url"),
        first_sentence(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        F.lit("  ").alias("author"),
        "lang",
    )


ITEMS_SQL = f"""items AS (
  SELECT doc_id AS raw_item_id, source AS source_id, doc_id AS seq, n_chars,
    'https://example.com/' || source || '/' || n_chars || '?a=1&b=2' AS canonical_url,
    {sql_collapse("CASE WHEN regexp_matches(" + sql_trim('text') + ", '^.*?[.!?](" + W + "|$)') THEN " + sql_trim("regexp_extract(" + sql_trim('text') + ", '^(.*?[.!?])(" + W + "|$)', 1)") + " ELSE " + sql_trim('text') + " END")} AS title,
    {sql_trim('text')} AS content, lang
  FROM documents),
hashed AS MATERIALIZED (
  SELECT *, sha256(canonical_url) AS url_hash,
    sha256({sql_fold("regexp_replace(title, '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]', '', 'g')")} || chr(10) ||
           {sql_fold("regexp_replace(content, '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]', '', 'g')")}) AS content_hash
  FROM items)"""
