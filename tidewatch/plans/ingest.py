"""Landed payloads, dedupe, upsert and sinks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.urls import repo_locator
from tidewatch.operators import ingest as ing
from tidewatch.operators import sinks
from tidewatch.operators.sequence import latest_per_key
from tidewatch.plans.registry import query
from tidewatch.plans.scalar import html_text_sql
from tidewatch.plans.views import ITEMS_SQL, SIGNALS_SQL, SOURCES_SQL, W, items, raw_items, sources, table
from tidewatch.session import run_dir, settle
from tidewatch.sources import assets
from tidewatch.sources import payloads as pay


def feed_payloads(spark, d):
    """Every page as a small feed document in one of the three dialects."""
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    pid = F.col("page_id").cast("string")
    address = F.replace("url", F.lit("&"), F.lit("&amp;"))
    cdata = lambda c: F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>c</title><item><title>'), cdata(title), F.lit("</title><link> "), address,
        F.lit(' </link><guid isPermaLink="false">g-'), pid, F.lit("</guid><dc:creator>Ann</dc:creator><description>"), cdata(F.col("html")),
        F.lit("</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><description>lost</description></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">'), cdata(title),
        F.lit('</title><link rel="self" href="http://self.example.com"/><link href="'), address, F.lit('"/><id>g-'), pid,
        F.lit('</id><author><name>Bob</name></author><content type="html">'), cdata(F.col("html")),
        F.lit("</content><updated>2024-01-02T03:04:05Z</updated></entry></feed>"),
    )
    rdf = F.concat(
        F.lit("<rdf:RDF><item><title>"), cdata(title), F.lit("</title><guid>"), address, F.lit("</guid><description>"), cdata(F.col("html")),
        F.lit("</description><dc:date>2024-01-03T00:00:00+01:00</dc:date></item></rdf:RDF>"),
    )
    kind = F.col("page_id") % 3
    return p.select(F.col("page_id").alias("source_id"), F.when(kind == 0, rss).when(kind == 1, atom).otherwise(rdf).alias("payload"))


@query("s1_feed_items", f"""
WITH p AS (SELECT page_id, url, {html_text_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {html_text_sql('html')} AS t FROM pages)
SELECT page_id AS source_id, CASE page_id % 3 WHEN 2 THEN url ELSE 'g-' || page_id END AS external_id, url, title,
  CASE page_id % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' END AS author, sha256(t) AS content_hash,
  CASE page_id % 3 WHEN 0 THEN epoch_us(TIMESTAMP '2024-01-01 10:00:00') WHEN 1 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05')
    ELSE epoch_us(TIMESTAMP '2024-01-02 23:00:00') END AS at_us, NULL AS reject_reason FROM p
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, sha256('lost'), NULL, 'entry without a usable title or link' FROM pages WHERE page_id % 3 = 0""")
def _(spark, d):
    return pay.feed_items(feed_payloads(spark, d)).select(
        "source_id", "external_id", "url", "title", "author", F.sha2("content", 256).alias("content_hash"),
        F.unix_micros("published_at").alias("at_us"), "reject_reason",
    )


@query("s2_s4_release_items", """
SELECT o_orderkey AS source_id, 'github:acme/r' || (o_custkey % 7) || ':' || o_orderkey AS external_id, 'https://github.com/x/' || o_orderkey AS url,
  'acme/r' || (o_custkey % 7) || ' ' || CASE o_orderstatus WHEN 'F' THEN 'Final' ELSE 'v' || o_orderkey END AS title, 'c' || o_custkey AS author,
  CASE o_orderstatus WHEN 'F' THEN 'Notes' ELSE 'Release v' || o_orderkey || ' published.' END AS content, epoch_us(date_trunc('second', o_orderdate)) AS at_us
FROM orders WHERE NOT o_orderpriority LIKE '5%' AND NOT (o_orderpriority LIKE '3%' AND o_custkey % 2 = 0)""")
def _(spark, d):
    o = table(spark, d, "orders")
    k, pr = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    yes = lambda c: F.when(c, "true").otherwise("false")
    payload = F.concat(
        F.lit('[{"id":'), k, F.lit(',"html_url":"https://github.com/x/'), k, F.lit('","tag_name":"v'), k, F.lit('","name":'),
        F.when(F.col("o_orderstatus") == "F", '"Final"').when(F.col("o_orderstatus") == "O", "null").otherwise('"  "'),
        F.lit(',"body":'), F.when(F.col("o_orderstatus") == "F", '" Notes "').otherwise("null"),
        F.lit(',"draft":'), yes(pr.startswith("5")), F.lit(',"prerelease":'), yes(pr.startswith("3")),
        F.lit(',"created_at":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z","author":{"login":"c'),
        F.col("o_custkey").cast("string"), F.lit('"}},{"tag_name":"shapeless"}]'),
    )
    locator = F.concat(F.lit(" https://www.github.com/acme/r"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"))
    rows = o.select(F.col("o_orderkey").alias("source_id"), locator.alias("locator"), payload.alias("payload"), (F.col("o_custkey") % 2 == 1).alias("pre"))
    out = pay.release_items(rows, F.col("pre"))
    return out.select("source_id", "external_id", "url", "title", "author", "content", F.unix_micros("published_at").alias("at_us"))


@query("s3_advisory_items", """
WITH p AS (SELECT *, (p_size % 10) + 0.5 AS score FROM part)
SELECT p_partkey AS source_id, 'CVE-2024-' || p_partkey AS external_id, 'https://nvd.nist.gov/vuln/detail/CVE-2024-' || p_partkey AS url,
  'CVE-2024-' || p_partkey || ' (' || CASE WHEN p_partkey % 5 = 0 THEN 'unscored' ELSE 'HIGH ' || printf('%.1f', score) END || ')' AS title,
  p_name || chr(10) || chr(10) || 'CVSS: ' || CASE WHEN p_partkey % 5 = 0 THEN 'unscored' ELSE 'HIGH ' || printf('%.1f', score) END
    || chr(10) || chr(10) || 'References:' || chr(10) || '- r1' || chr(10) || '- r2' || chr(10) || '- r3' || chr(10) || '- r4' || chr(10) || '- r5' AS content,
  epoch_us(TIMESTAMP '2024-02-03 04:05:06') AS at_us
FROM p WHERE p_partkey % 5 = 0 OR score >= 5""")
def _(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    metric = F.concat(
        F.when(F.col("p_partkey") % 2 == 0, '{"cvssMetricV31":').otherwise('{"cvssMetricV30":'),
        F.lit('[{"cvssData":{"baseScore":'), (F.col("p_size") % 10).cast("string"), F.lit('.5,"baseSeverity":"HIGH"}}]}'),
    )
    payload = F.concat(
        F.lit('{"vulnerabilities":[{"cve":{"id":"CVE-2024-'), k, F.lit('","published":"2024-02-03T04:05:06.000","descriptions":[{"lang":"es","value":"x"},{"lang":"en","value":" '),
        "p_name", F.lit(' "}],"metrics":'), F.when(F.col("p_partkey") % 5 == 0, "{}").otherwise(metric),
        F.lit(',"references":[{"url":"r1"},{"url":"r2"},{"url":"r3"},{"url":"r4"},{"url":"r5"},{"url":"r6"}]}}]}'),
    )
    out = pay.advisory_items(p.select(F.col("p_partkey").alias("source_id"), payload.alias("payload")), F.lit(5.0))
    return out.select("source_id", "external_id", "url", "title", "content", F.unix_micros("published_at").alias("at_us"))


@query("s4_repo_locator", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE 'own' || s_nationkey || '/rep' || s_suppkey END AS repo FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    own, rep = F.concat(F.lit("own"), F.col("s_nationkey").cast("string")), F.concat(F.lit("rep"), F.col("s_suppkey").cast("string"))
    kind = F.col("s_suppkey") % 4
    locator = (
        F.when(kind == 0, F.concat_ws("/", own, rep)).when(kind == 1, F.concat(F.lit("https://GitHub.com/"), own, F.lit("/"), rep, F.lit(".git")))
        .when(kind == 2, F.concat(F.lit("  http://www.github.com/"), own, F.lit("/"), rep, F.lit("/tree/main//"))).otherwise(own)
    )
    return s.select("s_suppkey", repo_locator(locator).alias("repo"))


@query("s5_source_config", """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 30 WHEN 1 THEN 45 WHEN 4 THEN 30 WHEN 5 THEN 7 ELSE NULL END AS lookback,
  CASE c_custkey % 8 WHEN 2 THEN 'malformed config JSON' WHEN 3 THEN 'lookbackDays: expected an integer from 1 to 120'
    WHEN 6 THEN 'minCvssScore: expected a number from 0 to 10' WHEN 7 THEN 'includePrereleases: expected a boolean' END AS config_error,
  CASE c_custkey % 8 WHEN 5 THEN 4.5::DOUBLE END AS floor FROM customer""")
def _(spark, d):
    k = F.col("c_custkey") % 8
    config = (
        F.when(k == 1, '{"lookbackDays": 45, "extra": 1}').when(k == 2, "{oops").when(k == 3, '{"lookbackDays": 121}')
        .when(k == 4, "{}").when(k == 5, '{"minCvssScore": 4.5, "lookbackDays": 7.0}').when(k == 6, '{"minCvssScore": "5"}')
        .when(k == 7, '{"includePrereleases": "yes"}')
    )
    rows = table(spark, d, "customer").select("c_custkey", F.when(k == 7, "github").otherwise("nvd").alias("kind"), config.alias("config"))
    out = pay.check_config(rows)
    ok = F.col("config_error").isNull()
    return out.select(
        "c_custkey", F.when(ok, F.col("lookback_days")).cast("bigint").alias("lookback"), "config_error", F.when(ok, F.col("min_cvss_score")).alias("floor")
    )


@query("s6_s7_incremental_window", f"""
WITH {SIGNALS_SQL}, c AS (SELECT source_id, TIMESTAMP '2024-01-20 00:00:00' + INTERVAL (source_id) HOUR - INTERVAL 24 HOUR AS since FROM sources WHERE source_id <> 3),
f AS (SELECT e.id, e.source_id, row_number() OVER (PARTITION BY e.source_id ORDER BY coalesce(epoch_us(published_at), 0) DESC, e.id) AS r
  FROM every_signal e LEFT JOIN c USING (source_id) WHERE since IS NULL OR published_at IS NULL OR published_at > since)
SELECT id, source_id, r::BIGINT AS batch_rank FROM f""")
def _(spark, d):
    s = sources(spark, d).withColumn(
        "last_fetched_at",
        F.when(F.col("source_id") != 3, F.lit("2024-01-20").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("source_id").cast("int"))),
    )
    rows = raw_items(spark, d).withColumn("position", F.col("raw_item_id"))
    out = pay.incremental(rows, pay.rewind(s))
    return out.select(F.col("raw_item_id").alias("id"), "source_id", F.col("batch_rank").cast("bigint").alias("batch_rank"))


@query("s7_cursor_advance", f"""
WITH {SOURCES_SQL}, r AS (SELECT DISTINCT user_id % 25 AS source_id FROM events WHERE event_type <> 'view' OR user_id % 25 < 20)
SELECT source_id, epoch_us(CASE WHEN r.source_id IS NOT NULL AND source_id % 2 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-01-10 00:00:00' END) AS cursor_us
FROM sources LEFT JOIN r USING (source_id)""")
def _(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'view' or user_id % 25 < 20")
    report = e.select((F.col("user_id") % 25).alias("source_id")).distinct().withColumn(
        "status", F.when(F.col("source_id") % 2 == 0, "ok").otherwise("failed")
    )
    s = sources(spark, d).withColumn("last_fetched_at", F.lit("2024-01-10").cast("timestamp"))
    out = pay.advance_cursor(s, report, F.lit("2024-01-31").cast("timestamp"))
    return out.select("source_id", F.unix_micros("last_fetched_at").alias("cursor_us"))


@query("s8_catalog_sync", f"""
WITH {SOURCES_SQL}, stored AS (SELECT kind, url, name, vendor, source_id % 3 <> 0 AS enabled FROM sources WHERE kind <> 'hn'
  UNION ALL SELECT 'rss', 'https://gone.example.com/' || r_name, r_name, NULL, false FROM region)
SELECT coalesce(c.kind, s.kind) AS kind, coalesce(c.url, s.url) AS url, CASE WHEN c.name IS NOT NULL THEN lower(c.name) ELSE s.name END AS name,
  c.vendor, coalesce(s.enabled, true) AS enabled
FROM stored s FULL JOIN sources c ON s.kind = c.kind AND s.url = c.url""")
def _(spark, d):
    s = sources(spark, d)
    never = F.lit(None).cast("timestamp")
    stored = s.filter("kind <> 'hn'").select(
        "kind", "url", "name", "vendor", F.lit("{}").alias("config"), (F.col("source_id") % 3 != 0).alias("enabled"), never.alias("last_fetched_at")
    )
    gone = table(spark, d, "region").select(
        F.lit("rss").alias("kind"), F.concat(F.lit("https://gone.example.com/"), "r_name").alias("url"), F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("vendor"), F.lit("{}").alias("config"), F.lit(False).alias("enabled"), never.alias("last_fetched_at"),
    )
    catalog = s.select("kind", "url", F.lower("name").alias("name"), "vendor", F.lit(None).cast("string").alias("config"))
    return sinks.sync_catalog(stored.unionByName(gone), catalog).select("kind", "url", "name", "vendor", "enabled")


@query("p15_source_filter", f"WITH {SOURCES_SQL} SELECT source_id, name FROM sources WHERE kind = 'rss' AND contains(lower(name || ' ' || url), 'nation_1')")
def _(spark, d):
    return pay.select_sources(sources(spark, d), kind="rss", match="Nation_1").select("source_id", "name")


@query("s9_upsert_latest", """
WITH u AS (SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY 1)
SELECT key, 'order ' || value AS state FROM u UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT key FROM u)""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey")
    newest = latest_per_key(o, ["key"], [F.col("o_orderdate"), F.col("o_orderkey")])
    updates = newest.select("key", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("state"))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("state"))
    return sinks.upsert_latest(base, updates, ["key"])


@query("s10_append_ledger", """
SELECT DISTINCT l_partkey AS item_id, l_suppkey AS subscription_id FROM lineitem
WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R')""")
def _(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("subscription_id"), "l_returnflag")
    ledger = pairs.filter("l_returnflag = 'R'").drop("l_returnflag")
    return sinks.append_new(ledger, pairs.drop("l_returnflag"), ["subscription_id", "item_id"]).select("item_id", "subscription_id")


@query("s13_labelled_pairs", """
SELECT d.doc_id::VARCHAR AS id, sha256(coalesce(p.text, '-')) AS prior_hash, sha256(coalesce(d.text, '-')) AS next_hash, d.source = p.source AS revised, CASE WHEN p.text IS NULL THEN 'new' ELSE 'update' END AS expected
FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1""")
def _(spark, d):
    docs = table(spark, d, "documents")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("prior"), F.col("source").alias("_s"))
    pairs = docs.join(before, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), "prior", F.col("text").alias("next"), (F.col("source") == F.col("_s")).alias("revised"),
        F.when(F.col("prior").isNull(), "new").otherwise("update").alias("expectedKind"),
    )
    path = run_dir(spark, "pairs")
    pairs.write.json(path)
    got = assets.read_change_pairs(spark, path, lines=True)
    return got.select(
        "id", F.sha2(F.coalesce("prior", F.lit("-")), 256).alias("prior_hash"), F.sha2(F.coalesce("next", F.lit("-")), 256).alias("next_hash"), "revised", F.col("expectedKind").alias("expected")
    )


def normalised(spark, d):
    return ing.normalise(items(spark, d))


@query("n1_normalise", f"WITH {ITEMS_SQL} SELECT raw_item_id, canonical_url, url_hash, content_hash, title FROM hashed WHERE title <> ''")
def _(spark, d):
    return ing.accepted(normalised(spark, d)).select("raw_item_id", "canonical_url", "url_hash", "content_hash", "title")


@query("n2_rejects", """
SELECT event_id AS raw_item_id, CASE WHEN event_type IN ('view', 'signup', 'error') THEN 'invalid url' ELSE 'empty title' END AS reject_reason
FROM events WHERE event_type IN ('view', 'signup', 'error') OR user_id % 7 = 0""")
def _(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_type")
    url = F.when(k == "view", "ftp://example.com/x").when(k == "signup", "localhost:8080/x").when(k == "error", "  ").when(
        k == "click", "Example.com/a b"
    ).otherwise("//www.example.com:443/x")
    rows = e.select(
        F.col("event_id").alias("raw_item_id"), url.alias("url"), F.when(F.col("user_id") % 7 == 0, " \n ").otherwise("t").alias("title"),
        F.lit("body").alias("content"), F.lit(None).cast("string").alias("author"),
    )
    return ing.rejects(ing.normalise(rows), "raw_item_id").select("raw_item_id", "reject_reason")


# The sequential definition, one step per arrival position of a source.
FIRST_WINS_SQL = f"""{ITEMS_SQL},
arrivals AS MATERIALIZED (SELECT source_id, seq, url_hash, content_hash, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM hashed WHERE title <> ''),
walk AS (
  SELECT source_id, 0::BIGINT AS n, []::VARCHAR[] AS urls, []::VARCHAR[] AS bodies, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome
  FROM (SELECT DISTINCT source_id FROM arrivals)
  UNION ALL
  SELECT w.source_id, a.n, CASE WHEN fresh THEN list_append(urls, a.url_hash) ELSE urls END,
    CASE WHEN fresh THEN list_append(bodies, a.content_hash) ELSE bodies END, a.seq,
    CASE WHEN list_contains(urls, a.url_hash) THEN 'repeated url' WHEN list_contains(bodies, a.content_hash) THEN 'repeated body' ELSE 'kept' END
  FROM walk w JOIN arrivals a ON a.source_id = w.source_id AND a.n = w.n + 1,
    LATERAL (SELECT NOT list_contains(urls, a.url_hash) AND NOT list_contains(bodies, a.content_hash) AS fresh)),
outcomes AS (SELECT source_id, seq, outcome FROM walk WHERE seq IS NOT NULL)"""


@query("n3_first_wins_dedupe", f"WITH RECURSIVE {FIRST_WINS_SQL} SELECT source_id, seq, outcome FROM outcomes")
def _(spark, d):
    rows = settle(ing.accepted(normalised(spark, d)).select("source_id", "seq", "url_hash", "content_hash"))
    kept = ing.first_wins(rows, "seq", ["source_id"])
    return ing.first_wins_report(rows, kept, "seq", ["source_id"]).select("source_id", "seq", "outcome")


def stored_and_batch(spark, d):
    """Stored: labelled documents, revised wording for the toxic ones. Batch: every document, deduped."""
    rows = settle(ing.accepted(normalised(spark, d)))
    batch = settle(ing.first_wins(rows, "seq"))
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("raw_item_id"), "toxic", "quality")
    base = batch.join(lab, "raw_item_id").withColumns(
        {
            "content_hash": F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")),
            "url_hash": F.when(F.col("raw_item_id") % 5 == 0, F.sha2("url_hash", 256)).otherwise(F.col("url_hash")),
            "external_id": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp"),
            "fetched_at": F.lit("2024-01-01").cast("timestamp"),
        }
    ).drop("toxic", "quality")
    batch = batch.withColumns({"external_id": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp")})
    return base, batch


GLOBAL_DEDUPE_SQL = f"""{ITEMS_SQL},
arrivals AS MATERIALIZED (SELECT seq, url_hash, content_hash, row_number() OVER (ORDER BY seq) AS n FROM hashed WHERE title <> ''),
walk AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS urls, []::VARCHAR[] AS bodies, NULL::BIGINT AS seq, false AS fresh
  UNION ALL
  SELECT a.n, CASE WHEN f.fresh THEN list_append(urls, a.url_hash) ELSE urls END,
    CASE WHEN f.fresh THEN list_append(bodies, a.content_hash) ELSE bodies END, a.seq, f.fresh
  FROM walk w JOIN arrivals a ON a.n = w.n + 1,
    LATERAL (SELECT NOT list_contains(urls, a.url_hash) AND NOT list_contains(bodies, a.content_hash) AS fresh) f),
batch AS MATERIALIZED (SELECT h.* FROM hashed h JOIN walk w ON w.seq = h.seq AND w.fresh),
base AS (SELECT b.raw_item_id, b.seq, CASE WHEN b.raw_item_id % 5 = 0 THEN sha256(b.url_hash) ELSE b.url_hash END AS url_hash,
    CASE WHEN toxic = 1 OR quality = 0 THEN sha256(b.content_hash || 'x') ELSE b.content_hash END AS content_hash, b.source_id
  FROM batch b JOIN labels l ON l.doc_id = b.raw_item_id),
hit AS (SELECT b.*, s.content_hash AS stored FROM batch b LEFT JOIN base s ON s.url_hash = b.url_hash),
revising AS (SELECT url_hash, seq AS revised_at FROM hit WHERE stored <> content_hash),
classified AS (SELECT h.*, CASE WHEN stored = content_hash THEN 'unchanged' WHEN stored IS NOT NULL THEN 'revised'
    WHEN EXISTS (SELECT 1 FROM base t LEFT JOIN revising r ON r.url_hash = t.url_hash
                 WHERE t.content_hash = h.content_hash AND (r.revised_at IS NULL OR r.revised_at > h.seq)) THEN 'duplicate' ELSE 'inserted' END AS status FROM hit h)"""


@query("n4_n5_upsert_classify", f"WITH RECURSIVE {GLOBAL_DEDUPE_SQL} SELECT raw_item_id, status FROM classified")
def _(spark, d):
    base, batch = stored_and_batch(spark, d)
    return ing.classify_upsert(base, batch).select("raw_item_id", "status")


@query("n4_upsert_apply", f"""WITH RECURSIVE {GLOBAL_DEDUPE_SQL}
SELECT 'base' AS part, s.url_hash, coalesce(CASE WHEN c.status = 'revised' THEN c.content_hash END, s.content_hash) AS content_hash,
  CASE WHEN c.status = 'revised' THEN '2024-01-31' ELSE '2024-01-01' END AS fetched FROM base s LEFT JOIN classified c ON c.url_hash = s.url_hash
UNION ALL SELECT 'base', url_hash, content_hash, '2024-01-31' FROM classified WHERE status = 'inserted'
UNION ALL SELECT 'revision', s.url_hash, s.content_hash, '2024-01-01' FROM base s JOIN classified c ON c.url_hash = s.url_hash AND c.status = 'revised'""")
def _(spark, d):
    base, batch = stored_and_batch(spark, d)
    columns = ["source_id", "canonical_url", "url_hash", *ing.CONTENT_COLUMNS, "fetched_at"]
    new_base, pre_images, _ = ing.upsert(base.select(*columns), batch, F.lit("2024-01-31").cast("timestamp"))
    fetched = F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched")
    return new_base.select(F.lit("base").alias("part"), "url_hash", "content_hash", fetched).unionByName(
        pre_images.select(F.lit("revision").alias("part"), "url_hash", "content_hash", fetched)
    )


@query("s11_snapshot_replay", f"""WITH RECURSIVE {GLOBAL_DEDUPE_SQL}
SELECT url_hash, content_hash, sha256(content) AS text_hash, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END::BIGINT AS revisions FROM batch b LEFT JOIN labels l ON l.doc_id = b.raw_item_id""")
def _(spark, d):
    """Two upserts of a snapshot: labelled documents have an earlier text, toxic ones are stored already."""
    raw = items(spark, d).withColumns({"external_id": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp")})
    kept = settle(ing.first_wins(settle(ing.accepted(ing.normalise(raw)).select("seq", "url_hash", "content_hash")), "seq").select("seq"))
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("seq"), "toxic", "quality")
    snap = raw.join(kept, "seq").join(lab, "seq", "left").withColumns(
        {"previous_content": F.when(F.col("quality") == 1, F.concat("content", F.lit(" earlier"))), "previous_title": F.lit(None).cast("string")}
    )
    stored = snap.filter("toxic = 1")
    passes = sinks.replay_plan(snap.drop("toxic", "quality"), stored.select("url"))
    columns = ["source_id", "canonical_url", "url_hash", *ing.CONTENT_COLUMNS, "fetched_at"]
    base = ing.accepted(ing.normalise(stored)).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")).select(*columns)
    pre_images = []
    for n, one in enumerate(passes):
        batch = settle(ing.first_wins(settle(ing.accepted(ing.normalise(one))), "seq"))
        base, old, _ = ing.upsert(settle(base), batch, F.lit(f"2024-01-3{n}").cast("timestamp"))
        base = base.select(*columns)
        pre_images.append(old.select("url_hash"))
    revised = pre_images[0].unionByName(pre_images[1]).groupBy("url_hash").agg(F.count("*").alias("n"))
    return base.join(revised, "url_hash", "left").select(
        "url_hash", "content_hash", F.sha2("content", 256).alias("text_hash"), F.coalesce("n", F.lit(0)).alias("revisions")
    )


@query("n6_upsert_report", f"""WITH RECURSIVE {GLOBAL_DEDUPE_SQL}
SELECT source_id, count(*) AS fetched, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'revised') AS revised,
  count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'duplicate') AS duplicate
FROM classified GROUP BY ROLLUP (source_id)""")
def _(spark, d):
    base, batch = stored_and_batch(spark, d)
    return ing.upsert_report(ing.classify_upsert(base, batch))


@query("n6_w5_changed_keys", f"WITH RECURSIVE {GLOBAL_DEDUPE_SQL} SELECT url_hash FROM classified WHERE status IN ('inserted', 'revised')")
def _(spark, d):
    base, batch = stored_and_batch(spark, d)
    return ing.changed_keys(ing.classify_upsert(base, batch))


@query("n6_rollup_lineitem", """
SELECT l_returnflag AS source_id, count(*) AS fetched, count(*) FILTER (l_linestatus = 'O') AS inserted, 0 AS revised, count(*) FILTER (l_linestatus = 'F') AS unchanged,
  0 AS duplicate FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("source_id"), F.when(F.col("l_linestatus") == "O", "inserted").otherwise("unchanged").alias("status")
    )
    return ing.upsert_report(li)


@query("n7_latest_revision", """
SELECT l_orderkey AS raw_item_id, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS revision_id FROM lineitem GROUP BY 1""")
def _(spark, d):
    rev = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("raw_item_id"), F.col("l_linenumber").alias("revision_id"), F.col("l_shipdate").alias("revised_at")
    )
    return ing.latest_revision(rev).select("raw_item_id", "revision_id")


@query("n8_failure_isolation", """
SELECT page_id AS source_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS items, CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM pages""")
def _(spark, d):
    p = feed_payloads(spark, d).withColumn(
        "payload", F.when(F.col("source_id") % 3 == 0, F.concat(F.lit("<html>"), F.substring("payload", 1, 30))).otherwise(F.col("payload"))
    )
    return ing.isolate_failures(p, pay.feed_items(p).filter("reject_reason is null"), "source_id")
