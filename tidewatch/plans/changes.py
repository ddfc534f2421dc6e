"""Change detection, fact chains and contradictions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.labels import dimension_of
from tidewatch.operators import changes, contradiction, facts
from tidewatch.operators.contradiction import NEGATIONS, POLARITY, STOPWORDS, _stem_word
from tidewatch.operators.sequence import top_per_key
from tidewatch.plans.gates import TURN_PAIRS_SQL, turn_pairs
from tidewatch.plans.registry import query
from tidewatch.plans.views import NOW_SQL, SIGNALS_SQL, now, signals, sql_collapse, sql_fold, sql_sentences, sql_trim, table
from tidewatch.session import settle, written


def _missing_sql(these: str, others: str) -> str:
    keys = f"list_transform({sql_sentences(others)}, lambda k: {sql_fold('k')})"
    return f"list_filter({sql_sentences(these)}, lambda s: NOT list_contains({keys}, {sql_fold('s')}))"


@query("d1_sentence_diff", f"""WITH {TURN_PAIRS_SQL}, ks AS (SELECT conv_id, turn, {sql_sentences('a')} AS sa, {sql_sentences('b')} AS sb FROM pairs),
kk AS (SELECT *, list_transform(sa, lambda x: {sql_fold('x')}) AS ka, list_transform(sb, lambda x: {sql_fold('x')}) AS kb FROM ks)
SELECT conv_id, turn, sha256(array_to_string(list_filter(sa, lambda s: NOT list_contains(kb, {sql_fold('s')})), '|')) AS removed,
  sha256(array_to_string(list_filter(sb, lambda s: NOT list_contains(ka, {sql_fold('s')})), '|')) AS added FROM kk""")
def _(spark, d):
    p = turn_pairs(spark, d).withColumn("diff", changes.sentence_diff(F.col("a"), F.col("b")))
    return p.select(
        "conv_id", "turn", F.sha2(F.array_join("diff.removed", "|"), 256).alias("removed"), F.sha2(F.array_join("diff.added", "|"), 256).alias("added")
    )


def revised_items(spark, d):
    p = turn_pairs(spark, d)
    return p.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("raw_item_id"),
        F.when(F.col("turn") % 8 == 0, "T2").otherwise(" T ").alias("title"),
        F.when(F.col("turn") % 4 == 0, F.replace("a", F.lit(" "), F.lit("  "))).otherwise(F.col("b")).alias("content"),
        F.lit("Sum").alias("summary"), F.lit(4).alias("impact_score"), F.lit("Pricing").alias("category"),
        F.when(F.col("turn") % 3 == 0, "github").otherwise("rss").alias("source_kind"), F.lit("T").alias("previous_title"), F.col("a").alias("previous_content"),
    )


@query("d2_classify_revision", f"""WITH {TURN_PAIRS_SQL}, r AS (SELECT conv_id * 1000 + turn AS id, turn, a, CASE WHEN turn % 4 = 0 THEN replace(a, ' ', '  ') ELSE b END AS c FROM pairs),
ks AS (SELECT id, turn, {sql_sentences('a')} AS sa, {sql_sentences('c')} AS sb FROM r),
kk AS (SELECT *, list_transform(sa, lambda x: {sql_fold('x')}) AS ka, list_transform(sb, lambda x: {sql_fold('x')}) AS kb FROM ks),
q AS (SELECT id, turn, list_filter(sa, lambda s: NOT list_contains(kb, {sql_fold('s')})) AS removed, list_filter(sb, lambda s: NOT list_contains(ka, {sql_fold('s')})) AS added FROM kk),
z AS (SELECT *, len(removed) = 0 AND len(added) = 0 AND turn % 8 <> 0 AS same FROM q)
SELECT id AS raw_item_id, CASE WHEN same THEN 'duplicate' ELSE 'update' END AS kind, CASE WHEN turn % 3 = 0 THEN 'release' ELSE 'pricing' END AS dimension,
  CASE WHEN same THEN NULL WHEN len(removed) > 0 THEN array_to_string(removed, ' ') WHEN turn % 8 = 0 THEN 'T' END AS before,
  CASE WHEN same THEN 'Sum' WHEN len(added) > 0 THEN array_to_string(added, ' ') WHEN turn % 8 = 0 THEN 'T2' ELSE 'Sum' END AS after,
  CASE WHEN same THEN 1 ELSE 4 END AS materiality,
  CASE WHEN same THEN 'Republished with no sentence-level changes.' ELSE 'Source revised the item: ' || len(removed) || ' sentence(s) removed, ' || len(added) || ' added.' END AS rationale FROM z""")
def _(spark, d):
    return changes.classify_revisions(revised_items(spark, d)).select("raw_item_id", "kind", "dimension", "before", "after", "materiality", "rationale")


def vector_items(spark, d):
    """Embeddings as dated items: the id gives the time, the label the vendor."""
    v = table(spark, d, "embeddings")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("vec_id").cast("int"))
    return v.select("vec_id", F.col("label").cast("string").alias("vendor"), F.when(F.col("vec_id") % 50 != 0, at).alias("at"), F.col("embedding").alias("vector"))


def triggers_and_corpus(spark, d):
    v = vector_items(spark, d)
    return (
        v.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("self_item"), "vendor", "at", "vector"),
        v.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).cast("bigint").alias("item_id"), "vendor", "at", "vector"),
    )


_VEC_SQL = """v AS MATERIALIZED (SELECT vec_id, label, CASE WHEN vec_id % 50 <> 0 THEN vec_id END AS ts0, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"""


@query("d4_j5_a8_similar_priors", f"""WITH {_VEC_SQL}, p AS (SELECT q.vec_id AS query_id, c.vec_id // 2 AS item_id, max(round(1 - list_distance(q.e, c.e) * list_distance(q.e, c.e) / 2, 9)) AS similarity,
    arg_min(c.vec_id, (-round(1 - list_distance(q.e, c.e) * list_distance(q.e, c.e) / 2, 9), c.vec_id)) AS chunk
  FROM v q JOIN v c ON c.label = q.label AND c.ts0 < coalesce(q.ts0, 1e9) AND c.vec_id // 2 <> q.vec_id GROUP BY 1, 2)
SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk) AS rank FROM p) WHERE rank <= 5""")
def _(spark, d):
    t, c = triggers_and_corpus(spark, d)
    return changes.similar_priors(t, c).select("query_id", "item_id", "similarity", "rank")


@query("d4_similar_priors_after_wide_cut", f"""WITH {_VEC_SQL}, w AS (SELECT q.vec_id AS query_id, c.vec_id, q.label AS ql, c.label AS cl, q.ts0 AS qat, c.ts0 AS cat,
    round(1 - list_distance(q.e, c.e) * list_distance(q.e, c.e) / 2, 9) AS similarity FROM v q, v c),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM w),
f AS (SELECT query_id, vec_id // 2 AS item_id, max(similarity) AS similarity FROM k WHERE r <= 24 AND ql = cl AND vec_id // 2 <> query_id AND cat < coalesce(qat, 1e9) GROUP BY 1, 2)
SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM f) WHERE rank <= 5""")
def _(spark, d):
    t, c = triggers_and_corpus(spark, d)
    return changes.similar_priors(t, c, candidate_k=24).select("query_id", "item_id", "similarity", "rank")


@query("d3_classify_prior", f"""WITH {_VEC_SQL}, p AS (SELECT q.vec_id AS id, c.vec_id AS prior, round(1 - list_distance(q.e, c.e) * list_distance(q.e, c.e) / 2, 9) AS similarity
  FROM v q JOIN v c ON c.label = q.label AND c.ts0 < coalesce(q.ts0, 1e9) AND c.vec_id <> q.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, prior) AS r FROM p) WHERE r = 1)
SELECT v.vec_id AS raw_item_id, CASE WHEN similarity >= 0.3 THEN 'rephrase' ELSE 'new' END AS kind, CASE WHEN similarity >= 0.3 THEN 'prior ' || prior END AS before,
  CASE WHEN similarity >= 0.3 THEN 1 ELSE 4 END AS materiality, CASE WHEN similarity >= 0.3 THEN prior::VARCHAR ELSE '' END AS evidence,
  CASE WHEN prior IS NULL THEN 'none' WHEN similarity >= 0.3 THEN 'close' ELSE 'far' END AS reason FROM v LEFT JOIN n ON n.id = v.vec_id""")
def _(spark, d):
    t, _ = triggers_and_corpus(spark, d)
    c = t.select(F.col("query_id").alias("chunk_id"), F.col("query_id").alias("item_id"), "vendor", "at", "vector")
    nearest = changes.similar_priors(t, c, k=1).select(
        F.col("query_id").alias("raw_item_id"), F.col("item_id").alias("prior_id"), "similarity",
        F.concat(F.lit("prior "), F.col("item_id").cast("string")).alias("prior_summary"), F.lit("").alias("prior_title"),
    )
    fresh = t.select(
        F.col("query_id").alias("raw_item_id"), F.lit("Product").alias("category"), F.lit("rss").alias("source_kind"), F.lit("s").alias("summary"), F.lit(4).alias("impact_score")
    )
    out = changes.classify_against_priors(fresh, nearest, 0.3)
    reason = F.when(F.col("rationale").startswith("Similarity"), "close").when(F.col("rationale").startswith("Nearest"), "far").otherwise("none")
    return out.select("raw_item_id", "kind", "before", "materiality", F.array_join("evidence", ",").alias("evidence"), reason.alias("reason"))


def change_rows(spark, d):
    """Signals as classified items: the kind follows the value, the evidence an earlier item."""
    s = signals(spark, d, "source_id")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "value", "user_id")
    kind = F.element_at(F.array(F.lit("new"), F.lit("update"), F.lit("rephrase"), F.lit("duplicate")), (F.floor(F.col("value") * 10) % 4 + 1).cast("int"))
    return s.join(e, "id").select(
        F.col("id").alias("item_id"), "vendor", dimension_of(F.col("category"), F.col("source_kind")).alias("dimension"), kind.alias("kind"),
        F.col("summary").alias("after"), F.col("published_at").alias("at"), F.array(F.col("id") - F.col("user_id")).alias("evidence"), "impact_score", "title", "url",
    )


CHANGES_SQL = f"""{SIGNALS_SQL},
change_rows AS (SELECT s.id AS item_id, s.vendor, CASE WHEN source_kind = 'github' THEN 'release' WHEN category = 'Security' THEN 'security' WHEN category = 'Product' THEN 'capability'
    WHEN category = 'Pricing' THEN 'pricing' ELSE 'positioning' END AS dimension,
    ['new', 'update', 'rephrase', 'duplicate'][(floor(e.value * 10)::BIGINT % 4 + 1)] AS kind, s.summary AS after, s.published_at AS ts0, s.id - e.user_id AS evidence, s.impact_score, s.title, s.url
  FROM signals s JOIN events e ON e.event_id = s.id),
facts AS MATERIALIZED (SELECT item_id AS fact_id, vendor, dimension, after AS fact, ts0 AS valid_from, kind,
    CASE WHEN kind = 'update' THEN lag(item_id) OVER w END AS previous_fact_id, CASE WHEN lead(kind) OVER w = 'update' THEN lead(item_id) OVER w END AS superseded_by,
    CASE WHEN lead(kind) OVER w = 'update' THEN lead(ts0) OVER w END AS superseded_at
  FROM change_rows WHERE vendor IS NOT NULL AND kind IN ('new', 'update') AND ts0 IS NOT NULL WINDOW w AS (PARTITION BY vendor, dimension ORDER BY ts0, item_id)),
links AS (SELECT c.item_id, CASE WHEN c.ts0 IS NOT NULL AND (f.valid_from, f.fact_id) < (c.ts0, c.item_id) AND (f.superseded_by IS NULL OR (f.superseded_at, f.superseded_by) > (c.ts0, c.item_id)) THEN f.fact_id END AS previous_fact_id
  FROM change_rows c LEFT JOIN facts f ON f.fact_id = c.evidence AND c.evidence <> c.item_id WHERE c.kind IN ('rephrase', 'duplicate')),
change_events AS (SELECT c.item_id AS trigger_item_id, coalesce(c.vendor, 'Market') AS vendor, c.dimension, c.kind, NULL::VARCHAR AS before, c.after,
    CASE WHEN c.kind IN ('new', 'update') THEN c.impact_score ELSE 1 END AS materiality, 'because ' || c.kind AS rationale,
    CASE WHEN c.vendor IS NOT NULL THEN coalesce(f.previous_fact_id, l.previous_fact_id) END AS previous_fact_id, f.fact_id AS new_fact_id, c.ts0 AS published_at, c.title AS trigger_title
  FROM change_rows c LEFT JOIN facts f ON f.fact_id = c.item_id LEFT JOIN links l ON l.item_id = c.item_id)"""


@query("d5_fact_chain", f"WITH {CHANGES_SQL} SELECT fact_id, vendor, dimension, fact, kind, previous_fact_id, superseded_by, epoch_us(superseded_at) AS gone_us FROM facts")
def _(spark, d):
    return changes.fact_chain(change_rows(spark, d)).select(
        "fact_id", "vendor", "dimension", "fact", "kind", "previous_fact_id", "superseded_by", F.unix_micros("superseded_at").alias("gone_us")
    )


PASSES_SQL = f"""{CHANGES_SQL},
asked AS (SELECT item_id, vendor, dimension, kind, after, coalesce(ts0, {NOW_SQL}) AS ts FROM change_rows WHERE vendor IS NOT NULL),
revised AS (SELECT item_id, vendor, dimension, CASE item_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'duplicate' ELSE 'update' END AS kind,
    CASE WHEN item_id % 2 = 0 THEN after ELSE 'Revised. ' || after END AS after, ts, kind IN ('new', 'update') AND item_id % 2 = 0 AS unchanged FROM asked WHERE item_id % 7 <> 0 AND item_id % 3 = 0),
ops AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vendor, dimension ORDER BY batch, ts, item_id) AS n FROM (
    SELECT 0::BIGINT AS batch, vendor, dimension, item_id, kind, after, ts FROM asked WHERE item_id % 7 <> 0
    UNION ALL SELECT 1, vendor, dimension, item_id, kind, after, ts FROM asked WHERE item_id % 7 = 0
    UNION ALL SELECT 1, vendor, dimension, item_id, kind, after, ts FROM revised WHERE NOT unchanged) WHERE kind IN ('new', 'update')),
walk AS (
  SELECT vendor, dimension, 0::BIGINT AS n, []::STRUCT(ts TIMESTAMP, b BIGINT, i BIGINT)[] AS held, NULL::STRUCT(ts TIMESTAMP, b BIGINT, i BIGINT) AS gone, NULL::BIGINT AS batch, NULL::BIGINT AS item_id, NULL::VARCHAR AS after
  FROM (SELECT DISTINCT vendor, dimension FROM ops)
  UNION ALL
  SELECT vendor, dimension, n, list_append(CASE WHEN gone IS NULL THEN held ELSE list_filter(held, lambda x: x <> gone) END, {{'ts': ts, 'b': batch, 'i': item_id}}), gone, batch, item_id, after
  FROM (SELECT o.*, w.held, CASE WHEN o.kind = 'update' THEN coalesce(list_max(list_filter(w.held, lambda x: x.i = o.item_id)), list_max(w.held)) END AS gone
        FROM walk w JOIN ops o ON o.vendor = w.vendor AND o.dimension = w.dimension AND o.n = w.n + 1)),
log AS MATERIALIZED (SELECT batch, item_id, vendor, dimension, after AS fact, gone.b AS previous_batch, gone.i AS previous_item FROM walk WHERE n > 0)"""


@query("d5_two_passes", f"""WITH RECURSIVE {PASSES_SQL}
SELECT l.batch, l.item_id, l.vendor, l.dimension, l.fact, l.previous_batch, l.previous_item, r.batch AS superseded_batch, r.item_id AS superseded_by
FROM log l LEFT JOIN log r ON r.previous_batch = l.batch AND r.previous_item = l.item_id""")
def _(spark, d):
    """A first pass over most items; a second over those that came late, and over revised ones, some of them unchanged."""
    rows = settle(change_rows(spark, d))
    late = F.col("item_id") % 7 == 0
    k = F.col("item_id") % 5
    revised = rows.filter(~late & (F.col("item_id") % 3 == 0)).withColumns(
        {
            "kind": F.when(k == 0, "new").when(k == 1, "duplicate").otherwise("update"),
            "after": F.when(F.col("item_id") % 2 == 0, F.col("after")).otherwise(F.concat(F.lit("Revised. "), "after")),
        }
    )
    log = facts.empty_log(spark)
    for batch, events in enumerate((rows.filter(~late), rows.filter(late).unionByName(revised))):
        log = log.plus(facts.advance(log, events, batch, now()))
    return facts.all_facts(log).select("batch", "item_id", "vendor", "dimension", "fact", "previous_batch", "previous_item", "superseded_batch", "superseded_by")


@query("d5_undated_facts", f"""WITH {CHANGES_SQL}, dated AS (SELECT *, coalesce(ts0, {NOW_SQL}) AS at0 FROM change_rows WHERE vendor IS NOT NULL AND kind IN ('new', 'update'))
SELECT item_id AS fact_id, epoch_us(at0) AS from_us, CASE WHEN kind = 'update' THEN lag(item_id) OVER w END AS previous_fact_id, CASE WHEN lead(kind) OVER w = 'update' THEN lead(item_id) OVER w END AS superseded_by
FROM dated WINDOW w AS (PARTITION BY vendor, dimension ORDER BY at0, item_id)""")
def _(spark, d):
    return changes.fact_chain(change_rows(spark, d), run_at=now()).select("fact_id", F.unix_micros("valid_from").alias("from_us"), "previous_fact_id", "superseded_by")


@query("d5_restatement_links", f"WITH {CHANGES_SQL} SELECT item_id, previous_fact_id FROM links")
def _(spark, d):
    rows = change_rows(spark, d)
    return changes.link_restatements(rows, changes.fact_chain(rows)).select("item_id", "previous_fact_id")


@query("d6_current_and_as_of", f"""WITH {CHANGES_SQL} SELECT 'now' AS state, fact_id, vendor, dimension FROM facts WHERE superseded_by IS NULL
UNION ALL SELECT 'then', fact_id, vendor, dimension FROM facts WHERE valid_from <= TIMESTAMP '2024-01-15' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '2024-01-15')""")
def _(spark, d):
    facts = changes.fact_chain(change_rows(spark, d))
    keep = ["fact_id", "vendor", "dimension"]
    then = changes.facts_as_of(facts, F.lit("2024-01-15").cast("timestamp"))
    return changes.current_facts(facts).select(F.lit("now").alias("state"), *keep).unionByName(then.select(F.lit("then").alias("state"), *keep))


@query("d6_fact_held_at_each_item", f"""WITH {CHANGES_SQL}
SELECT c.item_id, (SELECT arg_max(f.fact_id, (f.valid_from, f.fact_id)) FROM facts f WHERE f.vendor = c.vendor AND f.dimension = c.dimension AND f.valid_from <= c.ts0) AS held
FROM change_rows c WHERE c.vendor IS NOT NULL AND c.ts0 IS NOT NULL""")
def _(spark, d):
    rows = change_rows(spark, d)
    asks = rows.filter("vendor is not null and at is not null").select("item_id", "vendor", "dimension", "at")
    return changes.facts_at(asks, changes.fact_chain(rows)).select("item_id", "held")


def event_rows(spark, d):
    """Change events with their trigger's title and date. The id of an event is its trigger's. Rows and facts are written: what
    joins them all sorts in one task only what it joins, not what they come from."""
    rows = written(change_rows(spark, d), "change-rows")
    facts = written(changes.fact_chain(rows), "facts")
    classified = rows.select(
        F.col("item_id").alias("raw_item_id"), "vendor", "dimension", "kind", F.lit(None).cast("string").alias("before"), "after",
        F.when(F.col("kind").isin("new", "update"), F.col("impact_score")).otherwise(1).alias("materiality"),
        F.concat(F.lit("because "), "kind").alias("rationale"),
    )
    events = changes.change_events(classified, facts, changes.link_restatements(rows, facts))
    trigger = rows.select(F.col("item_id").alias("trigger_item_id"), F.col("title").alias("trigger_title"), F.col("at").alias("published_at"))
    return events.join(trigger, "trigger_item_id").withColumn("id", F.col("trigger_item_id"))


@query("d7_d8_change_events", f"WITH {CHANGES_SQL} SELECT trigger_item_id, vendor, dimension, kind, after, materiality::BIGINT AS materiality, previous_fact_id, new_fact_id FROM change_events")
def _(spark, d):
    return event_rows(spark, d).select(
        "trigger_item_id", "vendor", "dimension", "kind", "after", F.col("materiality").cast("bigint").alias("materiality"), "previous_fact_id", "new_fact_id"
    )


@query("d9_kind_report", f"WITH {CHANGES_SQL} SELECT kind, count(*) AS n FROM change_rows GROUP BY 1")
def _(spark, d):
    return changes.kind_report(change_rows(spark, d))


# Every document takes the embedding its id comes to when divided by their number, as in the search queries.
@query("d10_golden_evaluation", f"""
WITH p AS (SELECT a.doc_id AS id, CASE WHEN a.doc_id % 10 <> 0 THEN a.text END AS prior, b.text AS next, a.lang = b.lang AS revised, l.quality, list_transform(x.embedding, lambda v: v::DOUBLE) AS va, list_transform(y.embedding, lambda v: v::DOUBLE) AS vb
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 JOIN labels l ON l.doc_id = a.doc_id JOIN embeddings x ON x.vec_id = a.doc_id % (SELECT count(*) FROM embeddings) JOIN embeddings y ON y.vec_id = b.doc_id % (SELECT count(*) FROM embeddings)),
ks AS (SELECT *, {sql_sentences("coalesce(prior, '')")} AS sa, {sql_sentences('next')} AS sb FROM p),
kk AS (SELECT *, list_transform(sa, lambda x: {sql_fold('x')}) AS ka, list_transform(sb, lambda x: {sql_fold('x')}) AS kb FROM ks),
r AS (SELECT id, CASE WHEN revised AND prior IS NOT NULL THEN CASE WHEN list_sort(list_distinct(ka)) = list_sort(list_distinct(kb)) THEN 'duplicate' ELSE 'update' END
    WHEN prior IS NULL THEN 'new' WHEN list_dot_product(va, vb) >= 0.1 THEN 'rephrase' ELSE 'new' END AS actual,
    CASE WHEN quality = 1 THEN 'update' ELSE 'new' END AS expected FROM kk)
SELECT expected, actual, count(*) AS n FROM r GROUP BY 1, 2
UNION ALL SELECT 'all', 'correct', count(*) FILTER (actual = expected) FROM r""")
def _(spark, d):
    docs = table(spark, d, "documents")
    v = table(spark, d, "embeddings")
    n = v.count()
    vectors = v.select((F.col("vec_id") % n).alias("_v"), "embedding")
    prior_vectors = vectors.select(F.col("_v").alias("_a"), F.col("embedding").alias("prior_vector"))
    next_vectors = vectors.select(F.col("_v").alias("_b"), F.col("embedding").alias("next_vector"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"), F.col("lang").alias("next_lang"))
    pairs = (
        docs.join(nxt, "doc_id").join(table(spark, d, "labels"), "doc_id")
        .withColumns({"_a": F.col("doc_id") % n, "_b": (F.col("doc_id") + 1) % n}).join(prior_vectors, "_a").join(next_vectors, "_b")
        .select(
            F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("prior"), "next", (F.col("lang") == F.col("next_lang")).alias("revised"),
            F.when(F.col("quality") == 1, "update").otherwise("new").alias("expected"), "prior_vector", "next_vector",
        )
    )
    results = changes.evaluate_pairs(pairs, 0.1)
    table_of = results.groupBy("expected", "actual").agg(F.count("*").alias("n"))
    return table_of.unionByName(changes.accuracy(results).select(F.lit("all").alias("expected"), F.lit("correct").alias("actual"), F.col("correct").alias("n")))


# Claims carry figures and opposing words, appended to whole turns of conversation.
CLAIMS = [
    "Acme raises platform pricing by 20% to $1,200 in v2.1.",
    "Acme lowers platform pricing by 10% to $900 in v2.1.",
    "Acme does not support platform pricing exports.",
    "Acme supports platform pricing exports and released version 3.4.5.",
    "Acme discontinued platform pricing exports, free for all.",
    "Acme pricing stays flat; it increased and dropped 12.5 percent.",
]


def claim_pairs(spark, d):
    p = turn_pairs(spark, d)
    texts = F.array(*[F.lit(c) for c in CLAIMS])
    pick = lambda n: F.get(texts, (n % len(CLAIMS)).cast("int"))
    k = F.col("conv_id") + F.col("turn")
    return p.select(
        "conv_id", "turn", F.concat_ws(" ", "a", pick(k)).alias("a"), F.concat_ws(" ", "b", pick(k + 1 + F.col("turn") % 4)).alias("b")
    )


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
CLAIM_SQL = f"""{TURN_PAIRS_SQL},
texts AS (SELECT {'[' + ', '.join("'" + c.replace("'", "''") + "'" for c in CLAIMS) + ']'} AS c),
claims AS (SELECT conv_id, turn, a || ' ' || c[((conv_id + turn) % {len(CLAIMS)} + 1)::INT] AS a, b || ' ' || c[((conv_id + turn + 1 + turn % 4) % {len(CLAIMS)} + 1)::INT] AS b FROM pairs, texts)"""


def _features_sql(side: str) -> str:
    tokens = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({side}), '[''’]', '', 'g'), '[^a-z0-9%$.]+'), lambda t: regexp_replace(t, '^[.$%]+|[.$%]+$', '', 'g')), lambda t: t <> '')"
    return f"{tokens} AS tok_{side}"


def _stem_sql(t: str) -> str:
    return f"CASE WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN {t}[:-2] ELSE {t} END"


def _derived_sql(side: str) -> str:
    skip = _LIST(STOPWORDS + NEGATIONS)
    tok = f"tok_{side}"
    stems = f"list_transform(list_filter({tok}, lambda t: NOT list_contains({skip}, t) AND NOT regexp_matches(t, '^[0-9]')), lambda t: {_stem_sql('t')})"
    negated = (
        f"list_transform(list_filter({tok}, lambda t, i: NOT list_contains({skip}, t) AND len(list_intersect({tok}[greatest(i - 3, 1):i - 1], {_LIST(NEGATIONS)})) > 0), lambda t: {_stem_sql('t')})"
    )
    axes = []
    for axis, groups in POLARITY.items():
        terms = [
            f"list_filter({_LIST(g)}, lambda w: list_contains({stems}, {_stem_sql('w')}))[1]" for g in groups
        ]
        hits = " + ".join(f"(({t}) IS NOT NULL)::INT" for t in terms)
        group = "CASE " + " ".join(f"WHEN ({t}) IS NOT NULL THEN {i}" for i, t in enumerate(terms)) + " END"
        axes.append(f"CASE WHEN {hits} = 1 THEN {group} END AS {axis}_{side}, CASE WHEN {hits} = 1 THEN coalesce({', '.join(terms)}) END AS {axis}_term_{side}")
    money = f"list_transform(regexp_extract_all({side}, '[$€£]\\s?(\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda m: replace(m, ',', ''))"
    percent = f"regexp_extract_all({side}, '(?i)(\\d+(?:\\.\\d+)?)\\s?(?:%|percent\\b)', 1)"
    version = f"regexp_extract_all({side}, '(?:^|[^A-Za-z0-9_$€£.])v?(\\d+\\.\\d+(?:\\.\\d+)?)\\b', 1)"
    return f"{stems} AS stems_{side}, {negated} AS neg_{side}, {', '.join(axes)}, {money} AS money_{side}, {percent} AS percent_{side}, {version} AS version_{side}"


def _uniq_sql(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_ORDERED = _uniq_sql("stems_a")
_AXES_SQL = ", ".join(
    f"""CASE WHEN {x}_a <> {x}_b THEN 'opposing terms: "' || {x}_term_a || '" vs "' || {x}_term_b || '"' END""" for x in POLARITY
)
_FIGURES_SQL = ", ".join(
    f"CASE WHEN len({k}_a) > 0 AND len({k}_b) > 0 AND len(list_intersect({k}_a, {k}_b)) = 0 THEN '{label} differ: ' || array_to_string({_uniq_sql(k + '_a')}, ', ') || ' vs ' || array_to_string({_uniq_sql(k + '_b')}, ', ') END"
    for k, label in (("money", "amounts"), ("percent", "percentages"), ("version", "versions"))
)
VERDICT_SQL = f"""{CLAIM_SQL}, toks AS MATERIALIZED (SELECT *, {_features_sql('a')}, {_features_sql('b')} FROM claims),
feats AS MATERIALIZED (SELECT *, {_derived_sql('a')}, {_derived_sql('b')} FROM toks),
verdicts AS MATERIALIZED (SELECT *, CASE WHEN len(list_intersect(stems_a, stems_b)) < 2 THEN [] ELSE list_filter([
    'one side negates "' || list_filter({_ORDERED}, lambda w: list_contains(stems_b, w) AND list_contains(neg_a, w) <> list_contains(neg_b, w))[1] || '"',
    {_AXES_SQL}, {_FIGURES_SQL}], lambda s: s IS NOT NULL) END AS signals FROM feats)"""


@query("c1_c5_contradiction", f"WITH {VERDICT_SQL} SELECT conv_id, turn, len(signals) > 0 AS contradicts, array_to_string(signals, ' | ') AS signals FROM verdicts")
def _(spark, d):
    out = contradiction.detect(claim_pairs(spark, d), "a", "b")
    return out.select("conv_id", "turn", "contradicts", F.array_join("signals", " | ").alias("signals"))


@query("c5_judge_or_measures", f"WITH {VERDICT_SQL} SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE len(signals) > 0 END AS contradicts FROM verdicts")
def _(spark, d):
    rows = claim_pairs(spark, d).withColumn("judged", F.when(F.col("turn") % 3 == 0, True).when(F.col("turn") % 3 == 1, False))
    return contradiction.decide(rows, "a", "b", "judged").select("conv_id", "turn", "contradicts")


@query("j13_c6_structural_conflicts", f"""WITH {VERDICT_SQL}
SELECT conv_id * 1000 + turn AS trigger_item_id, 'v' || (conv_id % 10) || ' — pricing' AS topic, a AS then_text, b AS now_text,
  'These sources make opposing claims (' || array_to_string(signals, '; ') || '); both are shown rather than assuming the newer one is settled.' AS note
FROM (SELECT conv_id, turn, a AS b, b AS a, signals FROM verdicts) WHERE len(signals) > 0""")
def _(spark, d):
    p = claim_pairs(spark, d).withColumn("now_id", F.col("conv_id") * 1000 + F.col("turn"))
    events = p.select(
        F.col("now_id").alias("trigger_item_id"), F.concat(F.lit("v"), (F.col("conv_id") % 10).cast("string")).alias("vendor"), F.lit("pricing").alias("dimension"),
        F.lit("update").alias("kind"), F.col("b").alias("before"), F.col("a").alias("after"), (F.col("now_id") - 1).alias("previous_fact_id"), F.lit("ok").alias("status"),
    )
    facts = events.select(F.col("previous_fact_id").alias("fact_id"), F.col("previous_fact_id").alias("evidence_item_id"))
    items = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("t").alias("title"), F.col("text").alias("content"), F.lit("s").alias("summary")
    )
    out = contradiction.structural_conflicts(events, facts, items)
    return out.select("trigger_item_id", "topic", F.get("sides", 1)["text"].alias("then_text"), F.get("sides", 0)["text"].alias("now_text"), "note")


def drafted_conflicts(spark, d):
    p = claim_pairs(spark, d)
    side = lambda t, i: F.struct(t.alias("text"), i.alias("sourceId"), F.lit("q").alias("quote"))
    i = F.col("conv_id") * 1000 + F.col("turn")
    return p.select(
        i.alias("conflict_id"), i.alias("position"), F.concat(F.when(F.col("turn") % 2 == 0, "Topic ").otherwise("TOPIC "), (F.col("conv_id") % 40).cast("string")).alias("topic"),
        F.array(side(F.col("a"), i - 1), side(F.lit("Nothing shared."), i + 500), side(F.col("b"), i)).alias("sides"), F.lit("n").alias("note"),
    )


@query("c7_opposing_conflicts", f"WITH {VERDICT_SQL} SELECT conv_id * 1000 + turn AS conflict_id FROM verdicts WHERE len(signals) > 0")
def _(spark, d):
    return contradiction.opposing_conflicts(drafted_conflicts(spark, d)).select("conflict_id")


@query("c9_merge_conflicts", f"""WITH {TURN_PAIRS_SQL}, c AS (SELECT conv_id * 1000 + turn AS position, CASE WHEN turn % 2 = 0 THEN 'Topic ' ELSE 'TOPIC ' END || (conv_id % 40) AS topic FROM pairs),
e AS (SELECT *, 0 AS f FROM c UNION ALL SELECT position, topic, 1 FROM c WHERE position % 3 = 0)
SELECT arg_max(topic, (f, position)) AS topic, max((f, position)).position - 1 AS first_source FROM (SELECT {{'f': f, 'position': position}} AS k, * FROM e) GROUP BY lower(topic)""".replace("max((f, position)).position", "max(k).position"))
def _(spark, d):
    c = drafted_conflicts(spark, d)
    out = contradiction.merge_conflicts(c, c.filter(F.col("position") % 3 == 0))
    return out.select("topic", F.get("sides", 0)["sourceId"].alias("first_source"))


@query("c10_conflicts_of_item", f"WITH {TURN_PAIRS_SQL} SELECT conv_id * 1000 + turn AS conflict_id FROM pairs WHERE turn % 2 = 0")
def _(spark, d):
    c = drafted_conflicts(spark, d)
    even = F.floor(F.col("position") / 2) * 2
    return contradiction.conflicts_containing(c.filter("sides is not null"), F.when(F.col("position") % 2 == 0, even)).select("conflict_id")
