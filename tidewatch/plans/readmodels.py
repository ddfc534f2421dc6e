"""Ranked briefs, feeds, rosters, evidence, matrices, cards and digests over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cards, contradiction, evidence, gates, notify, ranking
from tidewatch.operators.sequence import top_per_key
from tidewatch.plans.changes import CHANGES_SQL, CLAIM_SQL, CLAIMS, VERDICT_SQL, event_rows
from tidewatch.plans.registry import query
from tidewatch.schemas import PAGE_SCAN_CHARS
from tidewatch.session import settle, written
from tidewatch.plans.scalar import html_text_sql
from tidewatch.plans.views import FOCUS, NOW_SQL, NOW_TEXT, SIGNALS_SQL, enriched, now, raw_items, signals, sources, sql_collapse, table
from tidewatch.functions.labels import string_array
from tidewatch.functions.text import TITLE_STOPWORDS, html_to_text

_BRIEF = "SELECT *, row_number() OVER (ORDER BY score DESC, published_at DESC NULLS LAST, id DESC) AS position FROM scored"
BRIEF_SQL = f"{SIGNALS_SQL}, ranked AS ({_BRIEF}), brief AS (SELECT * FROM ranked WHERE position <= 8)"
_CLEAN = sql_collapse("summary")


@query("j1_r1_r2_r3_ranked_brief", f"WITH {BRIEF_SQL} SELECT position, id, title, vendor, category, impact_score, round(score, 3) AS score FROM brief")
def ranked_brief(spark, d):
    return ranking.brief_items(signals(spark, d), now()).select("position", "id", "title", "vendor", "category", F.col("impact_score").cast("bigint").alias("impact_score"), "score")


@query("r1_r2_signal_scores", f"WITH {SIGNALS_SQL} SELECT id, score FROM scored")
def _(spark, d):
    return ranking.ranked(signals(spark, d), now()).select("id", "score")


@query("a10_brief_summary", f"""WITH {BRIEF_SQL} SELECT count(*) || ' insights in today''s brief, ' || count(*) FILTER (impact_score >= 4) || ' at impact 4 or higher. '
  || array_to_string(list(summary || ' [#' || id || ']' ORDER BY position) FILTER (position <= 3), ' ') AS summary FROM brief""")
def _(spark, d):
    return ranking.extractive_summary(ranking.brief_items(signals(spark, d), now()))


@query("x16_brief_claims", f"WITH {BRIEF_SQL} SELECT position, summary AS text, id AS source_id, regexp_extract(summary, '^(.*?[.!?])\\s', 1) AS quote FROM brief WHERE position <= 3")
def _(spark, d):
    items = ranking.brief_items(signals(spark, d), now()).withColumn("content", F.col("summary"))
    return ranking.extractive_claims(items)


# A long brief, so that both sides of some conflicts are in it; each item's text ends with a claim.
_DECORATED = 500
_CLAIMED = "summary || ' ' || c[(id % {n} + 1)::INT]".format(n=len(CLAIMS))
_DECORATION_SQL = f"""{CHANGES_SQL}, ranked AS ({_BRIEF}), brief AS (SELECT * FROM ranked WHERE position <= {_DECORATED}),
texts AS (SELECT {'[' + ', '.join("'" + c.replace("'", "''") + "'" for c in CLAIMS) + ']'} AS c),
said AS (SELECT id, {_CLAIMED} AS text FROM brief, texts),
claims AS (SELECT x.id AS conv_id, p.id AS turn, x.text AS a, p.text AS b FROM change_events e JOIN said x ON x.id = e.trigger_item_id JOIN said p ON p.id = e.previous_fact_id WHERE e.kind = 'update')"""


@query("p8_a11_brief_decoration", f"""WITH {VERDICT_SQL.replace(CLAIM_SQL, _DECORATION_SQL, 1)},
m AS (SELECT trigger_item_id FROM change_events WHERE kind IN ('new', 'update') AND materiality >= 4),
sides AS (SELECT conv_id AS id FROM verdicts WHERE len(signals) > 0 UNION SELECT turn FROM verdicts WHERE len(signals) > 0),
v AS MATERIALIZED (SELECT s.id, s.vendor, s.tier, s.published_at, list_transform(x.embedding, lambda y: y::DOUBLE) AS e FROM scored s JOIN embeddings x ON x.vec_id = s.id % (SELECT count(*) FROM embeddings)),
met AS (SELECT q.id, bool_or(c.tier = 'primary') AS confirmed FROM v q JOIN v c ON c.vendor = q.vendor AND c.id <> q.id AND (q.published_at IS NULL OR c.published_at IS NULL OR abs(epoch_us(q.published_at) - epoch_us(c.published_at)) <= 604800000000)
  WHERE q.id IN (SELECT id FROM brief) AND round(1 - list_distance(q.e, c.e) * list_distance(q.e, c.e) / 2, 9) >= 0.9 GROUP BY 1)
SELECT b.id, b.id IN (SELECT trigger_item_id FROM m) AS state_change, CASE WHEN b.tier = 'primary' THEN 'primary-source' WHEN met.confirmed THEN 'primary-confirmed' WHEN met.id IS NOT NULL THEN 'secondary-corroborated' ELSE 'single-source' END AS corroboration,
  CASE WHEN position <= 3 THEN regexp_extract(summary, '^(.*?[.!?])\\s', 1) ELSE '' END AS quotes, b.id IN (SELECT id FROM sides) AS contested FROM brief b LEFT JOIN met ON met.id = b.id""")
def _(spark, d):
    """The brief with the corroboration that other signals give its items and the conflicts between them."""
    s = settle(signals(spark, d))
    items = settle(ranking.brief_items(s, now(), _DECORATED).withColumn("content", F.col("summary")))
    claim = lambda i: F.get(F.array(*[F.lit(c) for c in CLAIMS]), (i % len(CLAIMS)).cast("int"))
    events = written(event_rows(spark, d), "events")
    n = table(spark, d, "embeddings").count()
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") % n).alias("_v"), F.col("embedding").alias("vector"))
    seen = s.select("id", "vendor", "tier", F.col("published_at").alias("at"), (F.col("id") % n).alias("_v")).join(vectors, "_v").drop("_v")
    asked = seen.join(items.select("id"), "id", "left_semi").withColumnRenamed("id", "raw_item_id")
    verdicts, _ = evidence.corroborate(asked, seen.withColumn("chunk_id", F.col("id")).withColumnRenamed("id", "item_id"), threshold=0.9)
    told = items.select("id", "title", "content", F.concat_ws(" ", "summary", claim(F.col("id"))).alias("summary"))
    updates = events.withColumn("after", F.concat_ws(" ", "after", claim(F.col("trigger_item_id"))))
    made = updates.select(F.col("new_fact_id").alias("fact_id"), F.col("trigger_item_id").alias("evidence_item_id")).filter("fact_id is not null")
    conflicts = contradiction.structural_conflicts(updates, made, told)
    out = ranking.decorate_brief(items, ranking.material_changes(events, items.select("id")), verdicts, ranking.extractive_claims(items), conflicts)
    return out.select("id", "state_change", "corroboration", F.array_join("quotes", "|").alias("quotes"), "contested")


@query("p1_p2_p5_signal_filter", f"""WITH {SIGNALS_SQL} SELECT id FROM signals
WHERE (title ILIKE '%user 1_%' OR summary ILIKE '%user 1_%' OR why_it_matters ILIKE '%user 1_%') AND vendor IS NOT NULL AND impact_score >= 3""")
def _(spark, d):
    return ranking.filter_signals(signals(spark, d), search=" USER 1_ ", impact_min=3).select("id")


@query("p3_p4_vendor_category", f"WITH {SIGNALS_SQL} SELECT id FROM signals WHERE lower(vendor) = 'v3' AND category IN ('Security', 'Pricing')")
def _(spark, d):
    return ranking.filter_signals(signals(spark, d), vendor="V3").filter(F.col("category").isin("Security", "Pricing")).select("id")


@query("r4_feed_order_title", f"WITH {SIGNALS_SQL} SELECT id, row_number() OVER (ORDER BY title ASC NULLS FIRST, id DESC) AS place FROM signals")
def _(spark, d):
    return gates.with_positions(signals(spark, d), order=ranking.feed_order("title", "asc")).select("id", F.col("position").alias("place"))


@query("r5_a3_signals_page", f"""WITH {SIGNALS_SQL}, f AS (SELECT * FROM signals WHERE vendor IS NOT NULL AND impact_score >= 2 AND category = 'Security'),
o AS (SELECT id, row_number() OVER (ORDER BY impact_score DESC NULLS LAST, id DESC) AS r, count(*) OVER () AS total FROM f)
SELECT id, total, CAST(ceil(total / 25.0) AS BIGINT) AS total_pages, 3 AS page, 51 AS from_row, 75 AS to_row FROM o WHERE r BETWEEN 51 AND 75""")
def _(spark, d):
    rows = ranking.filter_signals(signals(spark, d), impact_min=2).filter("category = 'Security'")
    return ranking.paginate(rows, ranking.feed_order("impact"), 3, 25).select("id", "total", "total_pages", "page", "from_row", "to_row")


@query("r5_page_clamped", f"""WITH {SIGNALS_SQL}, o AS (SELECT id, row_number() OVER (ORDER BY published_at ASC NULLS FIRST, id DESC) AS r, count(*) OVER () AS total FROM signals)
SELECT id, total AS to_row FROM o WHERE r > (ceil(total / 40.0)::BIGINT - 1) * 40""")
def _(spark, d):
    return ranking.paginate(signals(spark, d), ranking.feed_order("published", "asc"), 10**6, 40).select("id", "to_row")


@query("a2_category_facet", f"""WITH {SIGNALS_SQL} SELECT category, count(*) AS count FROM signals WHERE vendor IS NOT NULL AND impact_score >= 2 GROUP BY 1""")
def _(spark, d):
    return ranking.category_facet(ranking.filter_signals(signals(spark, d), impact_min=2))


@query("a1_p7_vendor_roster", f"""WITH {SIGNALS_SQL}, t AS (SELECT * FROM signals WHERE vendor IN ('v0', 'v1', 'v2', 'v3', 'v4', 'v5')),
c AS (SELECT vendor, category, count(*) AS n FROM t GROUP BY 1, 2), l AS (SELECT vendor, list(category ORDER BY n DESC, category) AS cats FROM c GROUP BY 1)
SELECT t.vendor, t.vendor AS slug, count(*) AS signal_count, epoch_us(max(published_at)) AS latest_us,
  first(title ORDER BY published_at DESC NULLS LAST, id DESC) AS latest_title, max(impact_score) AS max_impact, array_to_string(any_value(cats), ',') AS categories
FROM t JOIN l USING (vendor) GROUP BY 1""")
def _(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey % 10 < 6").select(F.concat(F.lit("V"), (F.col("n_nationkey") % 10).cast("string")).alias("vendor")).distinct()
    r = ranking.vendor_roster(ranking.tracked(signals(spark, d), names))
    return r.select(
        "vendor", "slug", "signal_count", F.unix_micros("latest_at").alias("latest_us"), "latest_title", F.col("max_impact").cast("bigint").alias("max_impact"),
        F.array_join("categories", ",").alias("categories"),
    )


@query("a1_customer_roster", """WITH c AS (SELECT n_name AS vendor, c_mktsegment AS category, count(*) AS n, max(o_orderkey) AS m FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT vendor, sum(n)::BIGINT AS signal_count, array_to_string(list(category ORDER BY n DESC, category), ',') AS categories FROM c GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(
        F.col("n_name").alias("vendor"), F.col("c_mktsegment").alias("category"), F.lit(1).alias("impact_score"), F.col("o_orderdate").alias("published_at"),
        F.col("o_orderkey").alias("id"), F.lit("t").alias("title"),
    )
    return ranking.vendor_roster(rows).select("vendor", "signal_count", F.array_join("categories", ",").alias("categories"))


@query("p13_point_lookups", f"""WITH {CHANGES_SQL} SELECT 'signal' AS what, id AS key, title AS value FROM signals WHERE id IN (SELECT max(event_id) FROM events WHERE value >= 1)
UNION ALL SELECT 'event', trigger_item_id, kind FROM change_events WHERE trigger_item_id IN (SELECT max(event_id) FROM events WHERE value >= 1)
UNION ALL SELECT 'vendor', count(*), 'v4' FROM signals WHERE vendor = 'v4'""")
def _(spark, d):
    last = table(spark, d, "events").filter("value >= 1").agg(F.max("event_id").alias("id"))
    s = signals(spark, d)
    one = s.join(last, "id", "left_semi").select(F.lit("signal").alias("what"), F.col("id").alias("key"), F.col("title").alias("value"))
    ev = event_rows(spark, d).join(last, "id", "left_semi").select(F.lit("event").alias("what"), F.col("id").alias("key"), F.col("kind").alias("value"))
    v = ranking.vendor_roster(s).filter("slug = 'v4'").select(F.lit("vendor").alias("what"), F.col("signal_count").alias("key"), F.col("vendor").alias("value"))
    return one.unionByName(ev).unionByName(v)


@query("p13_signal_detail", f"""WITH {SIGNALS_SQL} SELECT s.id, s.title, s.vendor, s.tier, s.source_kind, 'by ' || e.user_id AS author, sha256(props) AS content_hash, 'm' || e.user_id % 3 AS model,
  CASE WHEN e.user_id % 4 = 0 THEN '' ELSE 'p' || e.user_id END AS products, CASE WHEN e.user_id % 17 = 0 OR e.user_id % 19 = 0 THEN '' WHEN e.user_id % 7 = 0 THEN 'v' || e.user_id % 10 ELSE 'v' || e.user_id % 10 || ',v9' END AS vendors,
  epoch_us(s.created_at) AS created_us FROM signals s JOIN events e ON e.event_id = s.id WHERE s.id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def _(spark, d):
    e = table(spark, d, "events")
    u = F.col("user_id")
    made = e.select(
        F.col("event_id").alias("raw_item_id"), F.when(u % 4 == 0, "not a list").otherwise(F.concat(F.lit('["p'), u.cast("string"), F.lit('", 7]'))).alias("products"),
        F.lit("because").alias("rationale"), F.concat(F.lit("m"), (u % 3).cast("string")).alias("model"), F.lit("1").alias("prompt_version"),
    ).withColumn("products", string_array(F.col("products")))
    landed = e.select(F.col("event_id").alias("raw_item_id"), F.col("props").alias("content"), F.concat(F.lit("by "), u.cast("string")).alias("author"))
    ids = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    out = ranking.signal_detail(enriched(spark, d).join(made, "raw_item_id"), raw_items(spark, d).join(landed, "raw_item_id"), sources(spark, d), ids)
    return out.select(
        "id", "title", "vendor", "tier", "source_kind", "author", F.sha2("content", 256).alias("content_hash"), "model",
        F.array_join("products", ",").alias("products"), F.array_join("vendors", ",").alias("vendors"), F.unix_micros("created_at").alias("created_us"),
    )


@query("p13_stored_briefs", f"""WITH {SIGNALS_SQL}, b AS (SELECT strftime(published_at, '%Y-%m-%d') AS brief_date, array_to_string(list(id ORDER BY impact_score DESC, published_at DESC, id DESC)[1:8], ',') AS items FROM signals WHERE published_at IS NOT NULL GROUP BY 1)
SELECT 'latest' AS asked, brief_date, items FROM b WHERE brief_date = (SELECT max(brief_date) FROM b) UNION ALL SELECT 'day', brief_date, items FROM b WHERE brief_date = '2024-01-09'""")
def _(spark, d):
    s = signals(spark, d).filter("published_at is not null").withColumn("brief_date", F.date_format("published_at", "yyyy-MM-dd"))
    top = top_per_key(s, ["brief_date"], [F.desc("impact_score"), F.desc("published_at"), F.desc("id")], 8)
    briefs = top.groupBy("brief_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"].cast("string")), ",").alias("items"))
    latest = ranking.latest_brief(briefs).select(F.lit("latest").alias("asked"), "brief_date", "items")
    return latest.unionByName(ranking.brief_on(briefs, F.lit("2024-01-09")).select(F.lit("day").alias("asked"), "brief_date", "items"))


@query("r10_related_signals", f"""WITH {SIGNALS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY lower(vendor) ORDER BY published_at DESC NULLS LAST, id DESC) AS r FROM signals WHERE vendor IS NOT NULL)
SELECT focus_id, id, row_number() OVER (PARTITION BY focus_id ORDER BY r) AS rank FROM (
  SELECT f.id AS focus_id, n.id, n.r FROM signals f JOIN n ON n.vendor = f.vendor AND n.r <= 6 AND n.id <> f.id) QUALIFY rank <= 5""")
def _(spark, d):
    s = signals(spark, d)
    return ranking.related(s, s.select(F.col("id").alias("focus_id"), "vendor")).select("focus_id", "id", "rank")


@query("r11_timeline", f"""WITH {SIGNALS_SQL} SELECT vendor, strftime(published_at, '%Y-%m-%d') AS day, coalesce(strftime(max(published_at), '%b %-d, %Y'), 'Undated') AS label, count(*) AS n,
  first(id ORDER BY published_at DESC NULLS LAST, id DESC) AS first_id, first(id ORDER BY published_at ASC NULLS FIRST, id ASC) AS last_id
FROM signals WHERE vendor IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return ranking.timeline(signals(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("j4_a4_changes_feed", f"""WITH {CHANGES_SQL}, f AS (SELECT * FROM change_events WHERE kind IN ('new', 'update') AND dimension = 'pricing' AND vendor <> 'V1'
    AND (vendor ILIKE '%because%' OR before ILIKE '%because%' OR after ILIKE '%because%' OR rationale ILIKE '%because%' OR trigger_title ILIKE '%because%')),
o AS (SELECT trigger_item_id, materiality, row_number() OVER (ORDER BY materiality DESC NULLS LAST, trigger_item_id DESC) AS r, count(*) OVER () AS total FROM f)
SELECT 'row' AS part, trigger_item_id AS id, total AS n, '' AS vendor FROM o WHERE r <= 20
UNION ALL SELECT 'vendor', 0, 0, vendor FROM (SELECT DISTINCT vendor FROM change_events)
UNION ALL SELECT 'noise', trigger_item_id, 0, '' FROM change_events WHERE kind IN ('rephrase', 'duplicate')""")
def _(spark, d):
    ev = written(event_rows(spark, d), "events")
    page = ranking.paginate(
        ranking.filter_changes(ev, search="Because", dimension="pricing", kinds=["new", "update"]), ranking.feed_order("materiality"), 1, 20
    )
    none = F.lit("").alias("vendor")
    noise = ranking.filter_changes(ev, kinds=["rephrase", "duplicate"]).select(F.lit("noise").alias("part"), "id", F.lit(0).alias("n"), none)
    names = ranking.filter_changes(ev).select("vendor").distinct().select(F.lit("vendor").alias("part"), F.lit(0).alias("id"), F.lit(0).alias("n"), "vendor")
    return page.select(F.lit("row").alias("part"), "id", F.col("total").alias("n"), none).unionByName(names).unionByName(noise)


@query("p3_changes_vendor_case", f"WITH {CHANGES_SQL} SELECT trigger_item_id, kind FROM change_events WHERE vendor = 'Market'")
def _(spark, d):
    ev = written(event_rows(spark, d), "events")
    exact, other = ranking.filter_changes(ev, vendor="Market"), ranking.filter_changes(ev, vendor="market")
    return exact.unionByName(other).select("trigger_item_id", "kind")


@query("j4_trigger_join", f"WITH {CHANGES_SQL} SELECT trigger_item_id, kind, trigger_title, 'https://example.com/e/' || trigger_item_id AS trigger_url FROM change_events")
def _(spark, d):
    ev = event_rows(spark, d).drop("trigger_title", "published_at")
    return ranking.with_trigger(ev, raw_items(spark, d)).select("trigger_item_id", "kind", "trigger_title", "trigger_url")


@query("p9_p10_dimension_tier", f"WITH {CHANGES_SQL} SELECT c.item_id AS id, c.dimension, s.tier FROM change_rows c JOIN signals s ON s.id = c.item_id")
def _(spark, d):
    from tidewatch.functions.labels import dimension_of

    return signals(spark, d).select("id", dimension_of(F.col("category"), F.col("source_kind")).alias("dimension"), "tier")


_STOP = ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)


@query("p11_page_relevance", f"""
WITH p AS (SELECT page_id, lower(substr(t, 1, 200000)) AS hay, {html_text_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, 'thth ' || split_part(regexp_extract(url, '://([^/]*)', 1), '.', 1) AS vendor FROM (SELECT *, {html_text_sql('html')} AS t FROM pages)),
s AS (SELECT page_id + 1 AS page_id, title AS next_title FROM p),
q AS (SELECT p.*, list_distinct(list_filter(regexp_extract_all(lower(next_title), '[a-z0-9][a-z0-9.+-]{{3,}}'), lambda x: x NOT IN ({_STOP}))) AS terms,
    list_distinct(list_filter(regexp_extract_all(lower(vendor), '[a-z0-9][a-z0-9.+-]{{3,}}'), lambda x: x NOT IN ({_STOP}))) AS names FROM p JOIN s USING (page_id))
SELECT page_id, CASE WHEN (len(names) = 0 OR len(list_filter(names, lambda n: contains(hay, n))) > 0) AND (len(terms) = 0 OR len(list_filter(terms, lambda n: contains(hay, n))) / len(terms)::DOUBLE >= 0.5) THEN 'verified' ELSE 'irrelevant' END AS url_status FROM q""")
def _(spark, d):
    p = table(spark, d, "pages")
    title = html_to_text(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    host = F.split_part(F.regexp_extract("url", "://([^/]*)", 1), F.lit("."), F.lit(1))
    before = p.select((F.col("page_id") + 1).alias("page_id"), title.alias("title"))
    rows = p.select("page_id", html_to_text(F.col("html")).alias("text"), F.concat(F.lit("thth "), host).alias("vendor")).join(before, "page_id")
    return rows.select("page_id", ranking.page_verdict(F.col("text"), F.col("title"), F.col("vendor"), PAGE_SCAN_CHARS).alias("url_status"))


@query("t5_alert_rows", f"""WITH {BRIEF_SQL} SELECT id, '[impact ' || impact_score || '] ' || title || CASE WHEN vendor IS NULL THEN '' ELSE ' — ' || vendor END AS headline,
  CASE id % 3 WHEN 0 THEN '⚠ source link unreachable, not linked (' || url || ')' WHEN 1 THEN '⚠ source link did not resolve to a relevant page, not linked (' || url || ')' ELSE url END AS link
FROM brief WHERE impact_score >= 4""")
def _(spark, d):
    items = ranking.brief_items(signals(spark, d), now())
    k = F.col("id") % 3
    return ranking.alert_rows(items.withColumn("url_status", F.when(k == 0, "unreachable").when(k == 1, "irrelevant"))).select("id", "headline", "link")


# --- evidence and matrix -------------------------------------------------------------------------


def matrix_axes(spark, d):
    """Axes from the regions, cells from the nations."""
    r = table(spark, d, "region")
    cats = F.array(F.lit("Security"), F.lit("Product"), F.lit("Pricing"), F.lit("Business"), F.lit("Ecosystem"))
    k = F.col("r_regionkey").cast("int")
    return r.select(
        k.alias("axis_order"), F.lower("r_name").alias("axis_id"), F.initcap("r_name").alias("axis_label"), F.concat(F.lit("About "), "r_name").alias("description"),
        F.array(F.get(cats, k), F.get(cats, (k + 2) % 5)).alias("categories"),
    )


def matrix_cells(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    levels = F.array(F.lit("strong"), F.lit("partial"), F.lit("none"), F.lit("info"), F.lit("strong"), F.lit("strong"))
    rows = n.select(
        F.lower("r_name").alias("axis_id"), F.concat(F.lit("v"), (F.col("n_nationkey") % 10).cast("string")).alias("vendor"),
        F.get(levels, (F.col("n_nationkey") % 6).cast("int")).alias("level"), F.concat(F.lit("About "), "n_name").alias("note"), "n_nationkey",
    )
    return rows.groupBy("axis_id", "vendor").agg(F.min_by("level", "n_nationkey").alias("level"), F.min_by("note", "n_nationkey").alias("note"))


def matrix_vendors(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey % 10 < 8")
    return n.select(F.concat(F.lit("v"), (F.col("n_nationkey") % 10).cast("string")).alias("vendor")).distinct().withColumn("slug", F.col("vendor"))


MATRIX_SQL = """axes AS (SELECT r_regionkey AS axis_order, lower(r_name) AS axis_id, upper(r_name[1]) || lower(replace(r_name[2:], ' E', ' e')) AS axis_label0, r_name,
    [['Security','Product','Pricing','Business','Ecosystem'][r_regionkey + 1], ['Security','Product','Pricing','Business','Ecosystem'][(r_regionkey + 2) % 5 + 1]] AS categories FROM region),
cells AS (SELECT lower(r_name) AS axis_id, 'v' || (n_nationkey % 10) AS vendor, arg_min(['strong','partial','none','info','strong','strong'][n_nationkey % 6 + 1], n_nationkey) AS level,
    arg_min('About ' || n_name, n_nationkey) AS note FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2),
mvendors AS (SELECT DISTINCT 'v' || (n_nationkey % 10) AS vendor FROM nation WHERE n_nationkey % 10 < 8)"""

EVIDENCE_SQL = f"""{SIGNALS_SQL}, {MATRIX_SQL},
ev AS (SELECT s.*, axis_id FROM scored s JOIN mvendors m ON m.vendor = s.vendor JOIN axes a ON list_contains(a.categories, s.category) WHERE impact_score >= 3),
ranked_ev AS (SELECT *, row_number() OVER (PARTITION BY vendor, axis_id ORDER BY score DESC, published_at DESC NULLS LAST, id DESC) AS r FROM ev),
totals AS (SELECT vendor, axis_id, count(*) AS evidence_count, max(impact_score) AS max_impact,
    max(CASE WHEN published_at IS NULL THEN 0.0 ELSE pow(0.5, greatest(0.0::DOUBLE, (epoch_us({NOW_SQL}) - epoch_us(published_at)) / 86400000000.0::DOUBLE) / 30.0::DOUBLE) END) AS freshness,
    bool_or(tier = 'primary') AS has_primary, array_to_string(list(id ORDER BY r) FILTER (r <= 5), ',') AS evidence FROM ranked_ev GROUP BY 1, 2),
conf AS (SELECT *, 0.35::DOUBLE * max_impact / 5 + 0.25::DOUBLE * least(evidence_count, 3) / 3 + 0.25::DOUBLE * freshness + CASE WHEN has_primary THEN 0.15::DOUBLE ELSE 0 END AS value FROM totals),
confidence AS (SELECT *, CASE WHEN round(value, 12) >= 0.62 THEN 'high' WHEN round(value, 12) >= 0.38 THEN 'medium' ELSE 'low' END AS confidence FROM conf),
reviewed AS (SELECT 'v' || (event_id % 10) AS vendor, lower(r_name) AS axis_id, event_id AS id, ts, CASE WHEN event_id % 3 = 0 THEN 'approve' ELSE 'reject' END AS action,
    CASE WHEN event_id % 9 = 0 THEN 'oops' ELSE '' END AS bad, event_id FROM events JOIN region ON r_regionkey = event_id % 5 WHERE value >= 20)"""


def reviewed_rows(spark, d):
    """An audit log of approvals and rejections, from the high-value events."""
    e = table(spark, d, "events").filter("value >= 20")
    r = table(spark, d, "region")
    after = F.when(F.col("event_id") % 9 == 0, "oops").otherwise(
        F.concat(F.lit('{"level":"partial","note":"edit '), F.col("event_id").cast("string"), F.lit('"}'))
    )
    return e.join(r, F.col("event_id") % 5 == F.col("r_regionkey")).select(
        F.col("event_id").alias("revision_id"), F.concat(F.lit("v"), (F.col("event_id") % 10).cast("string")).alias("vendor"), F.lower("r_name").alias("axis_id"),
        F.when(F.col("event_id") % 3 == 0, "approve").otherwise("reject").alias("action"), after.alias("after_json"), F.col("event_id").alias("signal_id"),
        F.col("ts").alias("created_at"),
    )


def matrix_evidence(spark, d):
    return evidence.vendor_evidence(signals(spark, d), matrix_vendors(spark, d), now())


@query("m1_vendor_evidence", f"WITH {SIGNALS_SQL}, {MATRIX_SQL} SELECT s.id, s.vendor, s.tier, s.score FROM scored s JOIN mvendors m ON m.vendor = s.vendor")
def _(spark, d):
    return matrix_evidence(spark, d).select("id", "vendor", "tier", "score")


@query("j7_r7_a5_cell_confidence", f"WITH {EVIDENCE_SQL} SELECT vendor, axis_id, evidence_count, max_impact, round(freshness, 9) AS freshness, has_primary, evidence, confidence FROM confidence")
def _(spark, d):
    totals, rows = evidence.cell_evidence(matrix_evidence(spark, d), matrix_axes(spark, d))
    out = evidence.with_confidence(totals.join(evidence.evidence_ids(rows), ["vendor", "axis_id"]), now())
    return out.select(
        "vendor", "axis_id", "evidence_count", F.col("max_impact").cast("bigint").alias("max_impact"), "freshness", "has_primary",
        F.array_join("evidence", ",").alias("evidence"), "confidence",
    )


@query("m2_m3_j10_r8_suggestions", f"""WITH {EVIDENCE_SQL},
drv AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY vendor, axis_id ORDER BY score DESC, published_at DESC NULLS LAST, id DESC) AS n FROM ev e
  WHERE NOT EXISTS (SELECT 1 FROM reviewed r WHERE r.vendor = e.vendor AND r.axis_id = e.axis_id AND r.id = e.id)) WHERE n = 1)
SELECT d.vendor || '::' || d.axis_id || '::' || d.id AS suggestion_id, coalesce(c.level, 'none') AS current_level, coalesce(c.level, 'info') AS level,
  coalesce(c.note || ' — ', '') || regexp_extract(d.summary, '^(.*?[.!?])(\\s|$)', 1) || ' [#' || d.id || ']' AS note, f.evidence_count, f.confidence
FROM drv d JOIN confidence f USING (vendor, axis_id) LEFT JOIN cells c USING (vendor, axis_id) ORDER BY d.score DESC, suggestion_id LIMIT 8""")
def _(spark, d):
    out = evidence.suggest(matrix_evidence(spark, d), matrix_axes(spark, d), matrix_cells(spark, d), evidence.reviewed_ids(reviewed_rows(spark, d)), now())
    return out.select("suggestion_id", "current_level", "proposed.level", "proposed.note", "evidence_count", "confidence")


GRID_SQL = "grid AS (SELECT vendor, axis_id FROM mvendors, axes)"


def grid(spark, d):
    v = matrix_vendors(spark, d).agg(F.collect_list("vendor").alias("vs"))
    return matrix_axes(spark, d).select("axis_id", F.explode(v.scalar()).alias("vendor"))


APPROVED_SQL = """approved AS (SELECT vendor, axis_id, arg_max('edit ' || id, (ts, id)) AS note, arg_max(id, (ts, id)) AS signal_id FROM reviewed WHERE action = 'approve' AND bad = '' GROUP BY 1, 2)"""


@query("m4_explain_cells", f"""WITH {EVIDENCE_SQL}, {GRID_SQL}, {APPROVED_SQL}
SELECT g.vendor, g.axis_id, coalesce(c.level, 'none') AS level, coalesce(c.note, '—') AS note, coalesce(f.evidence, '') AS evidence, coalesce(f.evidence_count, 0) AS evidence_count,
  coalesce(f.confidence, 'low') AS confidence, a.signal_id AS last_updated_signal_id
FROM grid g LEFT JOIN cells c USING (vendor, axis_id) LEFT JOIN confidence f USING (vendor, axis_id) LEFT JOIN approved a USING (vendor, axis_id)""")
def _(spark, d):
    out = evidence.explain_cells(
        grid(spark, d), matrix_evidence(spark, d), matrix_axes(spark, d), matrix_cells(spark, d), evidence.latest_approvals(reviewed_rows(spark, d)), now()
    )
    return out.select("vendor", "axis_id", "level", "note", F.array_join("evidence", ",").alias("evidence"), "evidence_count", "confidence", "last_updated_signal_id")


@query("m5_j11_overlay", f"""WITH {EVIDENCE_SQL}, {GRID_SQL}, {APPROVED_SQL}, e AS (SELECT a.* FROM approved a JOIN grid USING (vendor, axis_id))
SELECT vendor, axis_id, CASE WHEN e.note IS NOT NULL THEN 'partial' ELSE c.level END AS level, coalesce(e.note, c.note) AS note FROM cells c FULL JOIN e USING (vendor, axis_id)""")
def _(spark, d):
    return evidence.overlay(matrix_cells(spark, d), evidence.latest_approvals(reviewed_rows(spark, d)), grid(spark, d))


@query("j11_approval_as_of", f"""WITH {EVIDENCE_SQL} SELECT vendor, axis_id, arg_max(id, (ts, id)) AS signal_id FROM reviewed
WHERE action = 'approve' AND bad = '' AND ts <= TIMESTAMP '2024-01-15' GROUP BY 1, 2""")
def _(spark, d):
    return evidence.latest_approvals(reviewed_rows(spark, d), F.lit("2024-01-15").cast("timestamp")).select("vendor", "axis_id", "signal_id")


@query("j11_approval_at_each_review", f"""WITH {EVIDENCE_SQL} SELECT r.id AS revision_id, (SELECT arg_max(a.id, (a.ts, a.id)) FROM reviewed a
  WHERE a.action = 'approve' AND a.bad = '' AND a.vendor = r.vendor AND a.axis_id = r.axis_id AND a.ts <= r.ts) AS signal_id FROM reviewed r""")
def _(spark, d):
    rows = reviewed_rows(spark, d)
    asks = rows.select("revision_id", "vendor", "axis_id", "created_at")
    return evidence.approvals_at(asks, rows).select("revision_id", F.col("approved.signal_id").alias("signal_id"))


@query("j6_a9_corroboration", """WITH v AS MATERIALIZED (SELECT vec_id, label, CASE WHEN vec_id % 50 <> 0 THEN vec_id END AS ts0, CASE WHEN vec_id % 6 = 0 THEN 'primary' ELSE 'secondary' END AS tier, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT q.vec_id AS id, c.vec_id AS other, c.tier, round(1 - list_distance(q.e, c.e) * list_distance(q.e, c.e) / 2, 9) AS sim FROM v q JOIN v c ON c.label = q.label AND c.vec_id <> q.vec_id
  AND (q.ts0 IS NULL OR c.ts0 IS NULL OR abs(q.ts0 - c.ts0) <= 168)),
g AS (SELECT id, count(*) AS n, max(sim) AS best, bool_or(tier = 'primary') AS p FROM p WHERE sim >= 0.15 GROUP BY 1)
SELECT v.vec_id AS raw_item_id, CASE WHEN tier = 'primary' THEN 'primary-source' WHEN g.p THEN 'primary-confirmed' WHEN g.n > 0 THEN 'secondary-corroborated' ELSE 'single-source' END AS status,
  coalesce(g.n, 0) AS corroborators, g.best FROM v LEFT JOIN g ON g.id = v.vec_id""")
def _(spark, d):
    from tidewatch.plans.changes import vector_items

    v = vector_items(spark, d).withColumn("tier", F.when(F.col("vec_id") % 6 == 0, "primary").otherwise("secondary"))
    asked = v.select(F.col("vec_id").alias("raw_item_id"), "vendor", "tier", "at", "vector")
    corpus = v.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("item_id"), "vendor", "tier", "at", "vector")
    verdict, _ = evidence.corroborate(asked, corpus, threshold=0.15)
    return verdict.select("raw_item_id", "status", "corroborators", "best")


# --- cards ---------------------------------------------------------------------------------------


@query("j12_b1_axis_split", f"""WITH {MATRIX_SQL} SELECT t.axis_id, t.vendor, CASE WHEN o.level = 'strong' AND t.level IN ('partial', 'none') THEN 'ours'
  WHEN t.level = 'strong' AND o.level IN ('partial', 'none', 'info') THEN 'theirs' WHEN o.level = 'strong' AND t.level = 'strong' THEN 'parity' ELSE 'none' END AS edge
FROM cells t JOIN cells o ON o.axis_id = t.axis_id AND o.vendor = '{FOCUS}' WHERE t.vendor <> '{FOCUS}'""")
def _(spark, d):
    return cards.axis_split(matrix_cells(spark, d), matrix_axes(spark, d), FOCUS).select("axis_id", "vendor", "edge")


CARDS_SQL = f"""{SIGNALS_SQL}, {MATRIX_SQL},
split AS (SELECT t.vendor, a.axis_order, a.r_name, o.note AS our_note, t.note AS their_note, CASE WHEN o.level = 'strong' AND t.level IN ('partial', 'none') THEN 'ours'
  WHEN t.level = 'strong' AND o.level IN ('partial', 'none', 'info') THEN 'theirs' WHEN o.level = 'strong' AND t.level = 'strong' THEN 'parity' ELSE 'none' END AS edge
  FROM cells t JOIN cells o ON o.axis_id = t.axis_id AND o.vendor = '{FOCUS}' JOIN axes a ON a.axis_id = t.axis_id),
edges AS (SELECT vendor, coalesce(list(axis_label ORDER BY axis_order) FILTER (edge = 'ours'), []) AS ours, coalesce(list(axis_label ORDER BY axis_order) FILTER (edge = 'theirs'), []) AS theirs,
    coalesce(list(axis_label ORDER BY axis_order) FILTER (edge = 'parity'), []) AS par
  FROM (SELECT *, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS axis_label FROM split) GROUP BY 1),
moves AS (SELECT vendor, list({{'id': id, 'title': title, 'summary': summary}} ORDER BY r) AS rec FROM (
    SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY score DESC, published_at DESC NULLS LAST, id DESC) AS r FROM scored WHERE vendor IS NOT NULL) WHERE r <= 5 GROUP BY 1),
cards AS (SELECT coalesce(m.vendor, s.vendor) AS vendor, coalesce(e.ours, []) AS ours, coalesce(e.theirs, []) AS theirs, coalesce(e.par, []) AS par, coalesce(s.rec, []) AS rec
  FROM mvendors m FULL JOIN moves s ON s.vendor = m.vendor LEFT JOIN edges e ON e.vendor = coalesce(m.vendor, s.vendor) WHERE coalesce(m.vendor, s.vendor) <> '{FOCUS}')"""


def battlecards(spark, d):
    return cards.battlecards(signals(spark, d), matrix_vendors(spark, d), matrix_axes(spark, d), matrix_cells(spark, d), FOCUS, now())


_CARD_SUMMARY_SQL = f"""CASE WHEN len(ours) + len(theirs) + len(par) = 0 THEN vendor || ' isn''t on the {FOCUS} comparison matrix yet — positioning here is based on '
      || CASE WHEN len(rec) = 0 THEN 'no tracked insights for ' || vendor || ' yet' ELSE len(rec) || ' tracked insight' || CASE WHEN len(rec) = 1 THEN '' ELSE 's' END END || '.'
    ELSE 'Against ' || vendor || ', {FOCUS} leads on ' || len(ours) || ' axis' || CASE WHEN len(ours) = 1 THEN '' ELSE 'es' END || CASE WHEN len(ours) > 0 THEN ' (' || array_to_string(ours[1:3], ', ') || ')' ELSE '' END || '.'
      || CASE WHEN len(theirs) > 0 THEN ' ' || vendor || ' is strongest on ' || array_to_string(theirs[1:3], ', ') || '.' ELSE ' ' || vendor || ' shows no clearly differentiated axis in our matrix.' END END
    || CASE WHEN len(rec) > 0 THEN ' Latest tracked move: ' || rec[1].summary || ' [#' || rec[1].id || ']' ELSE '' END"""


@query("b2_battlecards", f"""WITH {CARDS_SQL}
SELECT vendor, len(ours) AS n_ours, len(theirs) AS n_theirs, len(par) AS n_parity, array_to_string(list_transform(rec, lambda r: r.id), ',') AS recent,
  {_CARD_SUMMARY_SQL} AS summary,
  (len(ours) > 0)::INT + (len(theirs) > 0)::INT + (len(rec) > 0)::INT AS n_points FROM cards""")
def _(spark, d):
    return battlecards(spark, d).select(
        "vendor", F.size("our_strengths").alias("n_ours"), F.size("their_strengths").alias("n_theirs"), F.size("parity").alias("n_parity"),
        F.array_join(F.transform("recent", lambda r: r["id"].cast("string")), ",").alias("recent"), "summary", F.size("talking_points").alias("n_points"),
    )


@query("b3_u1_companies", f"""WITH {SIGNALS_SQL}, {MATRIX_SQL} SELECT vendor, vendor AS slug, true AS on_matrix FROM mvendors WHERE vendor <> '{FOCUS}'
UNION ALL SELECT DISTINCT vendor, vendor, false FROM signals WHERE vendor IS NOT NULL AND vendor <> '{FOCUS}' AND vendor NOT IN (SELECT vendor FROM mvendors)""")
def _(spark, d):
    return ranking.companies(matrix_vendors(spark, d), ranking.vendor_roster(signals(spark, d)), FOCUS)


@query("a6_card_staleness", f"""WITH {SIGNALS_SQL}, c AS (SELECT DISTINCT 'V' || (n_nationkey % 10) AS vendor, TIMESTAMP '2024-01-10' + INTERVAL (n_nationkey % 10) DAY AS generated_at FROM nation)
SELECT c.vendor, count(s.id) AS newer_signals FROM c LEFT JOIN signals s ON lower(c.vendor) = s.vendor AND coalesce(s.published_at, s.created_at) > c.generated_at GROUP BY 1""")
def _(spark, d):
    k = F.col("n_nationkey") % 10
    stored = table(spark, d, "nation").select(
        F.concat(F.lit("V"), k.cast("string")).alias("vendor"), (F.lit("2024-01-10").cast("timestamp") + F.make_dt_interval(k.cast("int"))).alias("generated_at")
    ).distinct()
    return cards.staleness(stored, signals(spark, d, "created_at"))


_EXPORT_SQL = f"""{CARDS_SQL},
named AS (SELECT *, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS axis_label FROM split),
sides AS (SELECT vendor, string_agg('- **' || axis_label || '** — ' || our_note || ' _(vs. ' || their_note || ')_', chr(10) ORDER BY axis_order) FILTER (edge = 'ours') AS wins,
    string_agg('- **' || axis_label || '** — ' || their_note, chr(10) ORDER BY axis_order) FILTER (edge = 'theirs') AS watch FROM named GROUP BY 1),
last AS (SELECT vendor, string_agg('- **' || title || '**' || coalesce(' (' || strftime(published_at, '%Y-%m-%d') || ')', '') || ' — ' || summary || ' [#' || id || ']', chr(10) ORDER BY r) AS recent,
    string_agg('- [#' || id || '] [' || title || '](' || url || ')', chr(10) ORDER BY r) AS sources
  FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY score DESC, published_at DESC NULLS LAST, id DESC) AS r FROM scored WHERE vendor IS NOT NULL) WHERE r <= 5 GROUP BY 1),
lines AS (SELECT c.vendor, regexp_replace({_CARD_SUMMARY_SQL}, '\\s*\\[#\\d+\\]', '', 'g') AS positioning, wins, watch, recent, sources, array_to_string(list_filter([
    CASE WHEN len(ours) > 0 THEN '- Lead with {FOCUS}''s edge on ' || array_to_string(ours[1:2], ' and ') || '.' END,
    CASE WHEN len(theirs) > 0 THEN '- Prepare to counter ' || c.vendor || ' on ' || array_to_string(theirs[1:2], ' and ') || '.' END,
    CASE WHEN len(rec) > 0 THEN '- Reference recent movement: "' || rec[1].title || '".' END], lambda x: x IS NOT NULL), chr(10)) AS points
  FROM (SELECT *, vendor AS v FROM cards) c LEFT JOIN sides USING (vendor) LEFT JOIN last USING (vendor))"""


@query("s14_markdown", f"""WITH {_EXPORT_SQL} SELECT vendor, array_to_string(list_filter([
  '# Battlecard — {FOCUS} vs. ' || vendor || chr(10) || chr(10) || '_Generated {NOW_TEXT[:10]} from tracked insights._' || chr(10),
  '## Positioning' || chr(10) || positioning || chr(10),
  '## Where {FOCUS} wins' || chr(10) || coalesce(wins, '- No differentiated advantage in the current matrix.') || chr(10),
  '## Watch-outs (' || vendor || ' strengths)' || chr(10) || coalesce(watch, '- None flagged in the current matrix.') || chr(10),
  CASE WHEN points <> '' THEN '## Talking points' || chr(10) || points || chr(10) END,
  '## Recent activity' || chr(10) || coalesce(recent, '- No tracked insights yet.') || chr(10),
  '## Sources' || chr(10) || sources || chr(10)], lambda x: x IS NOT NULL), chr(10)) AS markdown FROM lines""")
def _(spark, d):
    return battlecards(spark, d).select("vendor", cards.to_markdown(FOCUS, now()).alias("markdown"))


@query("r9_global_search", f"""WITH {CHANGES_SQL}, {MATRIX_SQL},
sig AS (SELECT 'insight' AS type, id::VARCHAR AS key, title, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id DESC) AS r FROM signals WHERE title ILIKE '%v1%' OR summary ILIKE '%v1%' OR why_it_matters ILIKE '%v1%'),
ros AS (SELECT 'competitor' AS type, vendor AS key, vendor AS title, row_number() OVER (ORDER BY count(*) DESC, max(published_at) DESC NULLS LAST, vendor) AS r FROM signals WHERE vendor IS NOT NULL AND contains(lower(vendor), 'v1') GROUP BY vendor),
chg AS (SELECT 'change' AS type, trigger_item_id::VARCHAR AS key, vendor || ' — ' || dimension AS title, row_number() OVER (ORDER BY published_at DESC NULLS LAST, trigger_item_id DESC) AS r FROM change_events
  WHERE vendor ILIKE '%v1%' OR after ILIKE '%v1%' OR rationale ILIKE '%v1%' OR trigger_title ILIKE '%v1%')
SELECT type, key, title, r AS rank FROM (SELECT * FROM sig UNION ALL SELECT * FROM ros UNION ALL SELECT * FROM chg) WHERE r <= 5
UNION ALL SELECT 'battlecard', vendor, vendor || ' battlecard', 1 FROM mvendors WHERE vendor = 'v1'""")
def _(spark, d):
    s = signals(spark, d)
    roster = ranking.vendor_roster(s)
    hits = ranking.search_hits(" V1 ", s, roster, ranking.companies(matrix_vendors(spark, d), roster, FOCUS), event_rows(spark, d), matrix_axes(spark, d))
    return hits.select("type", "key", "title", "rank")


@query("s12_matrix_asset", """SELECT lower(r_name) AS "where", 'axis' AS problem FROM region WHERE r_regionkey % 2 = 1
UNION ALL SELECT 'v' || n_nationkey || '::' || lower(r_name), 'level or note' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 = 3""")
def _(spark, d):
    from tidewatch.schemas import MATRIX_ASSET
    from tidewatch.sources import assets

    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    vendor = F.concat(F.lit("v"), F.col("n_nationkey").cast("string"))
    cell = F.struct(F.when(F.col("n_nationkey") % 4 == 3, "great").otherwise("info").alias("level"), F.lit("n").alias("note"))
    axes = n.groupBy("r_regionkey", "r_name").agg(F.map_from_entries(F.collect_list(F.struct(vendor, cell))).alias("cells"), F.collect_list(vendor).alias("vs"))
    axis = F.struct(
        F.lower("r_name").alias("id"), F.col("r_name").alias("label"), F.lit("d").alias("description"),
        F.array(F.when(F.col("r_regionkey") % 2 == 1, "Gossip").otherwise("Pricing")).alias("categories"), "cells",
    )
    named = F.transform(F.flatten(F.collect_list("vs")), lambda v: F.struct(v.alias("name"), v.alias("slug")))
    asset = axes.agg(F.to_json(F.struct(F.lit("v0").alias("focusVendor"), named.alias("vendors"), F.collect_list(axis).alias("axes"))).alias("value"))
    matrix = asset.select(F.from_json("value", MATRIX_ASSET).alias("m")).select("m.*")
    return assets.matrix_problems(matrix)


# --- subscriptions -------------------------------------------------------------------------------


def rules(spark, d):
    """One subscription per supplier, untidy on purpose."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    v = F.concat(F.lit("V"), (k % 10).cast("string"))
    empty = F.array().cast("array<string>")
    return s.select(
        k.alias("subscription_id"), F.concat(F.lit("s"), k.cast("string"), F.lit("@example.com")).alias("email"), F.lit(" ").alias("label"), (k % 7 != 0).alias("enabled"),
        F.when(k % 3 == 0, empty).otherwise(F.array(F.concat(F.lit(" "), v), F.lower(v), F.lit(""), F.lit("v9"))).alias("vendors"),
        F.when(k % 2 == 0, F.array(F.lit("Pricing"), F.lit("Security"), F.lit("Gossip"), F.lit("Pricing"))).otherwise(empty).alias("categories"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("USER "), k.cast("string")))).otherwise(empty).alias("keywords"),
        F.when(k % 4 == 0, F.lit(2.5)).when(k % 4 == 1, F.lit(0.2)).when(k % 4 == 2, F.lit(9.0)).alias("min_impact"), F.lit("hourly").alias("frequency"),
        F.lit(None).cast("timestamp").alias("last_notified_at"),
    )


RULES_SQL = """rules AS (SELECT s_suppkey AS sid, s_suppkey % 7 <> 0 AS enabled,
    CASE WHEN s_suppkey % 3 = 0 THEN [] WHEN s_suppkey % 10 = 9 THEN ['V9'] ELSE ['V' || (s_suppkey % 10), 'v9'] END AS vendors, CASE WHEN s_suppkey % 2 = 0 THEN ['Security', 'Pricing'] ELSE [] END AS categories,
    CASE WHEN s_suppkey % 5 = 0 THEN ['USER ' || s_suppkey] ELSE [] END AS keywords, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 2 THEN 5 END AS min_impact FROM supplier),
described AS (SELECT *, CASE WHEN len(categories) > 0 THEN array_to_string(categories, ' or ') || ' insights' ELSE 'All insights' END || CASE WHEN len(vendors) > 0 THEN ' about ' || array_to_string(vendors, ' or ') ELSE '' END
    || CASE WHEN min_impact IS NOT NULL THEN ' at impact ' || min_impact || '+' ELSE '' END || CASE WHEN len(keywords) > 0 THEN ' mentioning ''' || keywords[1] || '''' ELSE '' END AS label FROM rules)"""

MATCH_SQL = f"""{SIGNALS_SQL}, {RULES_SQL},
matches AS (SELECT r.sid, s.* FROM described r JOIN signals s ON (r.min_impact IS NULL OR s.impact_score >= r.min_impact)
  AND (len(r.vendors) = 0 OR list_contains(list_transform(r.vendors, lambda v: lower(v)), lower(s.vendor))) AND (len(r.categories) = 0 OR list_contains(r.categories, s.category))
  AND (len(r.keywords) = 0 OR contains(lower(s.title || chr(10) || s.summary || chr(10) || s.why_it_matters), lower(r.keywords[1])))),
ledger AS (SELECT o_custkey % 100 AS sid, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
digest AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY impact_score DESC, coalesce(epoch_us(published_at), 0) DESC, id DESC) AS rank FROM matches m
  WHERE sid IN (SELECT sid FROM rules WHERE enabled) AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.sid = m.sid AND l.id = m.id) QUALIFY rank <= 12)"""


def ledger(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return o.select((F.col("o_custkey") % 100).alias("subscription_id"), F.col("o_orderkey").alias("item_id"), F.lit("insight").alias("item_kind"))


@query("t1_t2_clean_rules", f"""WITH {RULES_SQL} SELECT sid AS subscription_id, array_to_string(vendors, ',') AS vendors, array_to_string(categories, ',') AS categories, min_impact, 'immediate' AS frequency, label FROM described""")
def _(spark, d):
    return notify.clean_rules(rules(spark, d)).select(
        "subscription_id", F.array_join("vendors", ",").alias("vendors"), F.array_join("categories", ",").alias("categories"), "min_impact", "frequency", "label"
    )


@query("j8_rule_matches", f"WITH {MATCH_SQL} SELECT sid AS subscription_id, id FROM matches")
def _(spark, d):
    return notify.match(signals(spark, d), notify.clean_rules(rules(spark, d))).select("subscription_id", "id")


@query("a7_match_counts", f"WITH {MATCH_SQL} SELECT r.sid AS subscription_id, count(m.id) AS matches FROM rules r LEFT JOIN matches m ON m.sid = r.sid GROUP BY 1")
def _(spark, d):
    return notify.preview_counts(signals(spark, d), notify.clean_rules(rules(spark, d)))


@query("j9_r6_digest_rows", f"WITH {MATCH_SQL} SELECT sid AS subscription_id, id, rank FROM digest")
def _(spark, d):
    on = notify.clean_rules(rules(spark, d)).filter("enabled")
    rows, sent = signals(spark, d), ledger(spark, d)
    matches = notify.match(rows, notify.narrowed(rows, on, sent))
    return notify.digest_rows(notify.undelivered(matches, sent)).select("subscription_id", "id", "rank")


_BLOCK = "'[' || impact_score || '] ' || title || chr(10) || coalesce(vendor || ' · ', '') || category || chr(10) || 'Why it matters — ' || why_it_matters || chr(10) || 'https://app/insights/' || id"


def _digest_text(n: str, head: str) -> str:
    return (
        f"{head} || chr(10) || chr(10) || body || chr(10) || chr(10) || 'You are receiving this because you subscribed to: ' || r.label || chr(10) || 'Manage or unsubscribe: https://app/notifications'"
    )


@query("t3_digests", f"""WITH {MATCH_SQL}, g AS (SELECT sid, count(*) AS n, array_to_string(list({_BLOCK} ORDER BY rank), chr(10)) AS body FROM digest GROUP BY 1)
SELECT g.sid AS subscription_id, n AS items, 'Digest · ' || n || ' insight' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' — ' || r.label AS subject,
  {_digest_text('n', "'Digest — ' || n || ' insight' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' for: ' || r.label")} AS text FROM g JOIN described r ON r.sid = g.sid""")
def _(spark, d):
    out = notify.digests(signals(spark, d), notify.clean_rules(rules(spark, d)), ledger(spark, d), "https://app/")
    return out.select("subscription_id", "items", "subject", "text")


@query("t3_s10_delivery_ledger", f"""WITH {MATCH_SQL}, g AS (SELECT sid, count(*) AS n FROM digest GROUP BY 1)
SELECT 'report' AS part, r.sid AS subscription_id, coalesce(n, 0) AS value, coalesce(r.sid % 2 = 0 AND n > 0, false) AS flag FROM rules r LEFT JOIN g ON g.sid = r.sid WHERE enabled
UNION ALL SELECT 'ledger', sid, id, true FROM digest WHERE sid % 2 = 0
UNION ALL SELECT 'notified', r.sid, 0, coalesce(r.sid % 2 = 0 AND n > 0, false) FROM rules r LEFT JOIN g ON g.sid = r.sid""")
def _(spark, d):
    cleaned = notify.clean_rules(rules(spark, d))
    sent = notify.digests(signals(spark, d), cleaned, ledger(spark, d), "https://app").withColumn("delivered", F.col("subscription_id") % 2 == 0)
    sent = settle(sent.select("subscription_id", "items", "item_ids", "delivered"))
    report = notify.delivery_report(cleaned, sent.select("subscription_id", "items", "delivered"))
    rows = notify.record_deliveries(ledger(spark, d), sent)
    marked = notify.mark_notified(cleaned, sent, now())
    return (
        report.select(F.lit("report").alias("part"), "subscription_id", F.col("matched").alias("value"), F.col("delivered").alias("flag"))
        .unionByName(rows.select(F.lit("ledger").alias("part"), "subscription_id", F.col("item_id").alias("value"), F.lit(True).alias("flag")))
        .unionByName(marked.select(F.lit("notified").alias("part"), "subscription_id", F.lit(0).alias("value"), F.col("last_notified_at").isNotNull().alias("flag")))
    )


@query("t4_previews", f"""WITH {MATCH_SQL}, hit AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY impact_score DESC, coalesce(epoch_us(published_at), 0) DESC, id DESC) AS rank FROM matches QUALIFY rank <= 12),
newest AS (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id DESC) AS rank FROM signals QUALIFY rank <= 3),
shown AS (SELECT sid, false AS sample, count(*) AS n, array_to_string(list(id ORDER BY rank), ',') AS ids, array_to_string(list({_BLOCK} ORDER BY rank), chr(10)) AS body FROM hit GROUP BY 1
  UNION ALL SELECT sid, true, 3, ids, body FROM rules, (SELECT array_to_string(list(id ORDER BY rank), ',') AS ids, array_to_string(list({_BLOCK} ORDER BY rank), chr(10)) AS body FROM newest) WHERE sid NOT IN (SELECT sid FROM matches))
SELECT g.sid AS subscription_id, sample, n AS items, ids, {_digest_text('n', "CASE WHEN sample THEN 'Digest — sample alert for: ' ELSE 'Digest — ' || n || ' insight' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' for: ' END || r.label")} AS text
FROM shown g JOIN described r ON r.sid = g.sid""")
def _(spark, d):
    out = notify.previews(signals(spark, d), notify.clean_rules(rules(spark, d)), "https://app")
    return out.select("subscription_id", "sample", "items", F.array_join("item_ids", ",").alias("ids"), "text")
