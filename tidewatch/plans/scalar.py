"""Text, address, label and vector expressions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import labels, text, urls, vectors
from tidewatch.functions.urls import TRACKING_PARAMS, TRACKING_PREFIXES
from tidewatch.operators.answers import is_small_talk
from tidewatch.operators.search import ACCENTED, FOLDED, QUERY_STOPWORDS, query_terms
from tidewatch.plans.registry import query
from tidewatch.plans.views import (
    NOW_SQL, SIGNALS_SQL, W, items, now, signals, sql_collapse, sql_fold, sql_sentences, sql_tokens, sql_trim, table, vendors_json,
)

_TRACKED = " AND ".join(
    ["lower(split_part(p, '=', 1)) NOT IN (" + ", ".join(f"'{t}'" for t in TRACKING_PARAMS) + ")"]
    + [f"NOT starts_with(lower(split_part(p, '=', 1)), '{t}')" for t in TRACKING_PREFIXES]
)
CANONICAL_SQL = rf"""canon AS (
  SELECT page_id, url, regexp_extract(trim(url), '^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS u
  FROM pages),
canonical AS (
  SELECT page_id, url, u.scheme || '://' || regexp_replace(lower(u.host), '^www\.', '')
    || regexp_replace(regexp_replace(u.path, '/{{2,}}', '/', 'g'), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM (SELECT *, list_sort(list_filter(string_split(substr(u.query, 2), '&'), lambda p: p <> '' AND {_TRACKED})) AS kept FROM canon))"""


@query("x3_x5_canonical_url", f"WITH {CANONICAL_SQL} SELECT page_id, canonical_url, sha256(canonical_url) AS url_hash FROM canonical")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))
    return p.withColumn("url_hash", urls.url_hash(F.col("canonical_url")))


# The oracle decodes one entity after the other, so the ampersand comes last.
_ENTITY_STEPS = [(name, put.replace("'", "''")) for name, put in sorted(text.NAMED_ENTITIES.items(), key=lambda e: e[0] == "amp")]


def html_text_sql(x: str) -> str:
    out = rf"regexp_replace({x}, '<script\b[^>]*>[\s\S]*?</script>|<style\b[^>]*>[\s\S]*?</style>', ' ', 'gi')"
    for pattern, put in ((r"<!--[\s\S]*?-->", "' '"), (r"<br\s*/?>", "chr(10)"), (r"<li\b[^>]*>", "'- '"), ("</li>", "chr(10)"),
                         ("</(p|div|h[1-6]|tr|section|article)>", "chr(10) || chr(10)"), ("<[^>]+>", "' '")):
        out = f"regexp_replace({out}, '{pattern}', {put}, 'gi')"
    for name, put in _ENTITY_STEPS:
        out = f"regexp_replace({out}, '&{name};', '{put}', 'gi')"
    blank = W.replace(r"\s", r"\t\r\f ")
    out = f"regexp_replace({out}, '{blank}+', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_trim(out)


@query("x6_x7_html_to_text", f"SELECT page_id, length(t) AS n_chars, sha256(t) AS text_hash FROM (SELECT page_id, {html_text_sql('html')} AS t FROM pages)")
def _(spark, d):
    t = table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))


@query("x7_entities", """
SELECT event_id, 'a ' || user_id || ' < b &unknown; ' || chr(65 + (user_id % 26)::INT) || chr(97 + (user_id % 26)::INT) || ' &lt; — x&y A' || chr(8364) || ' &#99999999999;' AS decoded FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    code = F.lit(65) + (F.col("user_id") % 26)
    coded = F.concat(
        F.lit("a "), F.col("user_id").cast("string"), F.lit(" &lt; b &unknown; &#"), code.cast("string"), F.lit(";&#x"),
        F.lower(F.hex(code + 32)), F.lit("; &amp;lt; &MDASH; x&y &#0000000000065;&#x00000000000020ac; &#99999999999;"),
    )
    return e.select("event_id", text.decode_entities(coded).alias("decoded"))


@query("x8_truncate", f"""
SELECT doc_id, length(t) AS n, sha256(t) AS h FROM (
  SELECT doc_id, CASE WHEN length(text) > 12000 THEN regexp_replace(substr(text, 1, 12000), '{W}+$', '') || '…' ELSE text END AS t FROM documents)""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("h"))


@query("x9_epoch_numbers", """
SELECT o_orderkey, epoch_us(o_orderdate) // 1000 * 1000 AS at_us, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE epoch_us(date_trunc('second', o_orderdate)) END AS text_us FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(
        "o_orderkey", F.unix_millis("o_orderdate").cast("double").alias("number"),
        F.when(F.col("o_custkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("never").alias("spelled"),
    )
    kinds = dict(rows.dtypes)
    return rows.select(
        "o_orderkey", F.unix_micros(text.instant(F.col("number"), kinds["number"])).alias("at_us"), F.unix_micros(text.instant(F.col("spelled"), kinds["spelled"])).alias("text_us")
    )


@query("x2_head_vendor", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'v' || c_nationkey WHEN 1 THEN 'src' || c_nationkey WHEN 2 THEN 'src' || c_nationkey WHEN 3 THEN 'src' || c_nationkey ELSE 'a' END AS head,
  CASE c_custkey % 5 WHEN 0 THEN 'v' || c_nationkey WHEN 1 THEN 'A' WHEN 2 THEN 'src' || c_nationkey WHEN 3 THEN 'src' || c_nationkey ELSE 'a' END AS first_string FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('["v'), n, F.lit('", "x"]'))).when(k == 1, '[1, "A"]').when(k == 2, "[]").when(k == 3, "{broken").otherwise('["a", 2]')
    own = F.concat(F.lit("src"), n)
    return c.select("c_custkey", labels.resolve_head_vendor(raw, own).alias("head"), labels.resolve_vendor(labels.string_array(raw), own).alias("first_string"))


@query("x9_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderpriority LIKE '4%' THEN NULL ELSE epoch_us(date_trunc('day', o_orderdate)) END AS at_us FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    day = F.date_trunc("day", "o_orderdate")
    p = F.col("o_orderpriority")
    spelled = (
        F.when(F.col("o_orderstatus") == "P", F.lit("soon"))
        .when(p.startswith("1"), F.concat(F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(p.startswith("2"), F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(p.startswith("3"), F.date_format(day, "MMMM d, yyyy"))
        .when(p.startswith("4"), F.lit("  "))
        .otherwise(F.date_format(day + F.expr("interval 2 hours"), "d MMM yyyy HH:mm:ss '+0200'"))
    )
    return o.select("o_orderkey", F.unix_micros(text.parse_date(spelled)).alias("at_us"))


@query("x10_x11_sentences", rf"""
SELECT doc_id, len(s) AS n, sha256(array_to_string(s, '|')) AS h, len(f) AS n_flat, sha256(array_to_string(f, '|')) AS h_flat FROM (
  SELECT doc_id, {sql_sentences('text')} AS s,
    list_filter(string_split(regexp_replace({sql_collapse('text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS f
  FROM documents)""")
def _(spark, d):
    s, f = text.sentences(F.col("text")), text.flat_sentences(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", s.alias("s"), f.alias("f"))
    return rows.select(
        "doc_id", F.size("s").cast("bigint").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("h"),
        F.size("f").cast("bigint").alias("n_flat"), F.sha2(F.array_join("f", "|"), 256).alias("h_flat"),
    )


@query("x12_x13_x14_document_tokens_slug", f"""
SELECT doc_id, {sql_tokens('text')} AS tokens,
  sha256(CASE WHEN h = '' THEN b WHEN b = '' THEN h ELSE h || chr(10) || chr(10) || b END) AS doc_hash, slug
FROM (SELECT doc_id, text, {sql_collapse('lang')} AS h, {sql_collapse('text')} AS b,
  regexp_replace(regexp_replace(lower(source || ' ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents)""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", text.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"),
        F.sha2(text.document(F.col("lang"), F.col("text")), 256).alias("doc_hash"),
        text.slug(F.concat("source", F.lit(" "), "lang", F.lit("!"))).alias("slug"),
    )


@query("x4_content_hash", f"""
WITH t AS (SELECT doc_id, lang, {sql_fold("regexp_replace(text, '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]', '', 'g')")} AS body FROM documents)
SELECT doc_id, sha256(lang || chr(10) || body) AS content_hash FROM t""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.content_hash(F.col("lang"), F.col("text")).alias("content_hash"))


@query("x15_x26_citations", """
SELECT event_id, CASE WHEN event_id = user_id THEN event_id::VARCHAR ELSE event_id || ',' || user_id END AS cited,
  'See for ' || event_type || '.' AS stripped FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    t = F.concat(F.lit("See  [#"), eid, F.lit("] [#"), uid, F.lit("] for "), "event_type", F.lit(" [#"), eid, F.lit("]."))
    return e.select(
        "event_id", F.array_join(text.citations(t).cast("array<string>"), ",").alias("cited"), text.strip_citations(t).alias("stripped")
    )


_HEAD = r"regexp_extract(b, '^(.*?[.!?])\s', 1)"


@query("x16_x17_x18_quotes", rf"""
WITH t AS (SELECT doc_id, text, {sql_collapse('text')} AS b, {sql_trim('text')} AS r FROM documents),
h AS (SELECT *, {_HEAD} AS head FROM t),
q AS (SELECT *, trim(substr(b, 1, least(CASE WHEN length(head) > 8 THEN length(head) + 1 ELSE length(b) END, 220))) AS lq FROM h)
SELECT doc_id, CASE WHEN length(lq) >= 8 THEN lq ELSE trim(substr(b, 1, 220)) END AS leading_quote,
  trim(substr(b, 1, CASE WHEN length(head) > 40 THEN length(head) ELSE least(length(b), 180) END)) AS answer_quote,
  CASE WHEN regexp_matches(r, '^.*?[.!?]({W}|$)') THEN {sql_trim(f"regexp_extract(r, '^(.*?[.!?])({W}|$)', 1)")} ELSE r END AS first_sentence
FROM q""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.leading_quote(F.lit(""), t).alias("leading_quote"), text.answer_quote(t).alias("answer_quote"),
        text.first_sentence(t).alias("first_sentence"),
    )


_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOPWORDS)


@query("x19_x20_terms_snippet", rf"""
WITH t AS (SELECT doc_id, text, {sql_collapse('text')} AS b FROM documents),
c AS (SELECT *, substr(b, 1, 120) AS cut FROM t),
k AS (SELECT *, 120 - (strpos(reverse(cut), ' ')) AS last_blank FROM c),
terms AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.+-]{{3,}}'), lambda x: x NOT IN ({_STOP})))), ' ') AS joined FROM t)
SELECT doc_id, sha256(joined) AS terms_hash,
  CASE WHEN length(b) <= 120 THEN b ELSE rtrim(CASE WHEN strpos(cut, ' ') > 0 AND last_blank > 40 THEN substr(cut, 1, last_blank) ELSE cut END) || '…' END AS snippet
FROM k JOIN terms USING (doc_id)""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(F.array_join(F.array_sort(text.significant_terms(t)), " "), 256).alias("terms_hash"), text.snippet(t).alias("snippet")
    )


@query("x21_labels", f"""
WITH {SIGNALS_SQL}, a AS (SELECT *, floor((epoch_us({NOW_SQL}) - epoch_us(published_at)) / 86400000000.0::DOUBLE)::BIGINT AS days FROM signals)
SELECT id, CASE impact_score WHEN 5 THEN 'Act now' WHEN 4 THEN 'High' WHEN 3 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Noise' END AS impact,
  CASE WHEN published_at IS NULL THEN '' WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || 'd ago'
       WHEN days < 30 THEN (days // 7) || 'w ago' ELSE (days // 30) || 'mo ago' END AS age,
  coalesce(strftime(published_at, '%b %-d, %Y'), 'Undated') AS label,
  CASE WHEN contains(source_name, ' ') THEN upper(split_part(source_name, ' ', 1)[1] || split_part(source_name, ' ', 2)[1]) ELSE upper(source_name[1:2]) END AS mark
FROM a""")
def _(spark, d):
    return signals(spark, d).select(
        "id", labels.impact_label(F.col("impact_score")).alias("impact"), labels.relative_age(F.col("published_at"), now()).alias("age"),
        labels.date_label(F.col("published_at")).alias("label"), labels.initials(F.col("source_name")).alias("mark"),
    )


@query("x22_code_fence", "SELECT event_id, props AS body FROM events")
def _(spark, d):
    fenced = F.when(
        F.col("user_id") % 2 == 0, F.concat(F.lit("```JSON\n"), "props", F.lit("\n```  "))
    ).otherwise(F.concat(F.lit("\n "), "props", F.lit(" ")))
    return table(spark, d, "events").select("event_id", text.strip_code_fence(fenced).alias("body"))


@query("x23_small_talk", "SELECT event_id, event_type IN ('click', 'view', 'signup') AND NOT (event_type = 'view' AND user_id % 2 = 0) AS small_talk FROM events")
def _(spark, d):
    k, user = F.col("event_type"), F.col("user_id").cast("string")
    said = (
        F.when(k == "click", F.lit("Heyyy, there!! 👋"))
        .when(k == "view", F.concat(F.lit("Thank you"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" for fixing "), user)).otherwise(".")))
        .when(k == "signup", F.lit("what  can you\nhelp me with?"))
        .when(k == "error", F.concat(F.lit("hey, what broke for "), user, F.lit("?")))
        .otherwise(F.lit("..."))
    )
    return table(spark, d, "events").select("event_id", is_small_talk(said).alias("small_talk"))


_QSTOP = ", ".join("'" + w.replace("'", "''") + "'" for w in QUERY_STOPWORDS)
QUERY_TERMS_SQL = rf"""questions AS (
  SELECT item_id AS query_id, text FROM benchmark UNION ALL
  SELECT 1000000 + conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'),
query_terms AS (
  SELECT query_id, phrase, count(*)::BIGINT AS weight FROM (
    SELECT query_id, array_to_string(list_filter(regexp_split_to_array(translate(lower(t), '{ACCENTED}', '{FOLDED}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ') AS phrase
    FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._-]*'), lambda t: length(t) > 2 AND lower(t) NOT IN ({_QSTOP}))) AS t FROM questions))
  GROUP BY ALL)"""


def questions(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    c = table(spark, d, "conversations").filter("role = 'user'")
    return b.unionByName(c.select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"))


@query("x24_query_terms", f"WITH {QUERY_TERMS_SQL} SELECT query_id, phrase, weight FROM query_terms")
def _(spark, d):
    return query_terms(questions(spark, d)).select("query_id", "phrase", "weight")


@query("x25_last_hop", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'local' ELSE '10.0.0.' || user_id END AS client FROM events")
def _(spark, d):
    header = F.when(F.col("event_type") == "error", F.lit(" , ")).otherwise(
        F.concat(F.lit("1.1.1.1, 10.0.0."), F.col("user_id").cast("string"), F.lit(" , "))
    )
    return table(spark, d, "events").select("event_id", urls.last_hop(header).alias("client"))


@query("x1_x2_vendor_resolution", f"WITH {SIGNALS_SQL} SELECT id, vendor, tier FROM signals")
def _(spark, d):
    return signals(spark, d).select("id", "vendor", "tier")


@query("x1_string_array", """
SELECT event_id, CASE WHEN user_id % 17 = 0 OR user_id % 19 = 0 THEN '' WHEN user_id % 7 = 0 THEN 'v' || (user_id % 10)
  ELSE 'v' || (user_id % 10) || ',v9' END AS vendors FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(labels.string_array(vendors_json()), ",").alias("vendors"))


@query("v4_v5_unit_pad_cosine", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e, len(e) AS n FROM v)
SELECT a.vec_id, round(sqrt(list_dot_product(a.e, a.e)), 6) AS norm, 96::BIGINT AS padded,
  round(list_distance(a.e, b.e), 6) AS distance, round(1 - list_distance(a.e, b.e) * list_distance(a.e, b.e) / 2, 6) AS cosine
FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def _(spark, d):
    v = table(spark, d, "embeddings").select(
        "vec_id", vectors.unit(F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))).alias("e")
    )
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    distance = vectors.l2_distance(vectors.pad(F.col("e"), 96), vectors.pad(F.col("f"), 96))
    return v.join(after, "vec_id").select(
        "vec_id", F.round(vectors.norm(F.col("e")), 6).alias("norm"), F.size(vectors.pad(F.col("e"), 96)).cast("bigint").alias("padded"),
        F.round(distance, 6).alias("distance"), F.round(vectors.cosine_from_l2(distance), 6).alias("cosine"),
    )


@query("p12_quote_grounding", f"""
WITH t AS (SELECT doc_id, text, {sql_collapse('text')} AS b FROM documents), q AS (SELECT *, replace(substr(b, 5, 40), ' ', '   ') AS quote FROM t)
SELECT doc_id, length({sql_collapse('quote')}) >= 8 AND contains({sql_fold('text')}, {sql_fold('quote')}) AS grounded FROM q""")
def _(spark, d):
    quote = F.replace(F.substring(text.collapse(F.col("text")), 5, 40), F.lit(" "), F.lit("   "))
    return table(spark, d, "documents").select("doc_id", text.quote_is_grounded(quote, F.col("text")).alias("grounded"))


@query("n1_normalise_title", f"""
WITH t AS (SELECT doc_id, {sql_trim('text')} AS r FROM documents)
SELECT doc_id, {sql_collapse(f"CASE WHEN regexp_matches(r, '^.*?[.!?]({W}|$)') THEN " + sql_trim(f"regexp_extract(r, '^(.*?[.!?])({W}|$)', 1)") + " ELSE r END")} AS title FROM t""")
def _(spark, d):
    return items(spark, d).select(F.col("raw_item_id").alias("doc_id"), text.collapse(F.col("title")).alias("title"))
