"""Validation gates and work-lists over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.text import collapse
from tidewatch.operators import gates
from tidewatch.plans.registry import query
from tidewatch.plans.views import SIGNALS_SQL, W, enriched, raw_items, sql_collapse, sql_fold, table


def completions(spark, d):
    """A model reply per event, sound or broken in one of a dozen ways."""
    e = table(spark, d, "events")
    k = F.col("user_id") % 12
    uid = F.col("user_id").cast("string")
    category = F.when(k == 2, '"Gossip"').otherwise('"Pricing"')
    impact = F.when(k == 3, '"3"').when(k == 4, "3.0").when(k == 9, "6").otherwise("4")
    vendors = F.when(k == 5, '["v1",""]').when(k == 11, "null").otherwise(F.concat(F.lit('["v'), uid, F.lit('"]')))
    summary = F.when(k == 7, "").otherwise(F.concat(F.lit('"summary":"User '), uid, F.lit('",')))
    rationale = F.when(k == 6, '"rationale":null,').when(k == 10, '"rationale":"because","extra":[1],').otherwise("")
    body = F.concat(
        F.lit('{"category":'), category, F.lit(',"vendors":'), vendors, F.lit(',"impact_score":'), impact, F.lit(","), summary, rationale,
        F.lit('"why_it_matters":"w"}'),
    )
    reply = (
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure! "), body))
        .when(k == 8, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    )
    return e.select(F.col("event_id").alias("raw_item_id"), "ts", "user_id", reply.alias("completion"))


_REASON = """CASE user_id % 12 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'schema mismatch — category: not an allowed value'
  WHEN 3 THEN 'schema mismatch — impact_score: expected an integer from 1 to 5' WHEN 5 THEN 'schema mismatch — vendors: expected non-empty strings'
  WHEN 6 THEN 'schema mismatch — rationale: expected a non-empty string' WHEN 7 THEN 'schema mismatch — summary: expected a non-empty string'
  WHEN 8 THEN 'schema mismatch — expected an object' WHEN 9 THEN 'schema mismatch — impact_score: expected an integer from 1 to 5'
  WHEN 11 THEN 'schema mismatch — vendors: expected non-empty strings' END"""


@query("e2_e3_validate_enrichment", f"""
WITH r AS (SELECT event_id AS raw_item_id, user_id, {_REASON} AS quarantine_reason FROM events)
SELECT raw_item_id, quarantine_reason, CASE WHEN quarantine_reason IS NULL THEN 'ok' ELSE 'quarantined' END AS status,
  CASE WHEN quarantine_reason IS NULL THEN 'Pricing' ELSE 'Ecosystem' END AS category, CASE WHEN quarantine_reason IS NULL THEN 'v' || user_id ELSE '' END AS vendors,
  CASE WHEN quarantine_reason IS NOT NULL THEN 1 WHEN user_id % 12 = 4 THEN 3 ELSE 4 END AS impact_score,
  CASE WHEN quarantine_reason IS NULL THEN 'User ' || user_id ELSE '' END AS summary, CASE WHEN user_id % 12 = 10 THEN 'because' END AS rationale FROM r""")
def _(spark, d):
    v = gates.validate_enrichment(completions(spark, d))
    return v.select(
        "raw_item_id", "quarantine_reason", "status", "category", F.array_join("vendors", ",").alias("vendors"), "impact_score", "summary", "rationale"
    )


@query("e5_run_report", f"""
SELECT count(*) AS attempted, count(*) FILTER (r IS NULL) AS ok, count(*) FILTER (r IS NOT NULL) AS quarantined, 0 AS failed FROM (SELECT {_REASON} AS r FROM events)""")
def _(spark, d):
    return gates.run_report(gates.validate_enrichment(completions(spark, d)))


@query("e1_j2_pending", """
WITH d AS (SELECT event_id, max(created) AS created, arg_max(status, created) AS status, max(attempts) AS attempts FROM (
    SELECT event_id, ts + INTERVAL (CASE WHEN user_id % 3 = 0 THEN -10 ELSE 0 END) SECOND AS created,
      CASE WHEN user_id % 4 = 0 THEN 'quarantined' ELSE 'ok' END AS status, user_id % 5 AS attempts FROM events WHERE value >= 2
    UNION ALL SELECT event_id, ts - INTERVAL 1 DAY, 'quarantined', 0 FROM events WHERE value >= 2) GROUP BY 1)
SELECT event_id AS raw_item_id, CASE WHEN created IS NULL THEN 'missing' WHEN floor(epoch_ms(created) / 1000) < floor(epoch_ms(ts) / 1000) THEN 'stale' ELSE 'retry' END AS pending_reason
FROM events LEFT JOIN d USING (event_id)
WHERE created IS NULL OR floor(epoch_ms(created) / 1000) < floor(epoch_ms(ts) / 1000) OR (status = 'quarantined' AND attempts < 3)""")
def _(spark, d):
    e = table(spark, d, "events").filter("value >= 2")
    lag = F.make_dt_interval(secs=F.when(F.col("user_id") % 3 == 0, F.lit(10)).otherwise(F.lit(0)))
    now_rows = e.select(
        F.col("event_id").alias("raw_item_id"), (F.col("ts") - lag).alias("created_at"),
        F.when(F.col("user_id") % 4 == 0, "quarantined").otherwise("ok").alias("status"), (F.col("user_id") % 5).alias("attempts"),
    )
    old_rows = e.select(
        F.col("event_id").alias("raw_item_id"), (F.col("ts") - F.expr("interval 1 day")).alias("created_at"), F.lit("quarantined").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"),
    )
    return gates.pending(raw_items(spark, d), now_rows.unionByName(old_rows)).select("raw_item_id", "pending_reason")


@query("e4_attempts", f"""
SELECT event_id AS raw_item_id, CASE WHEN value >= 2 THEN user_id % 5 + 1 ELSE 1 END AS attempts, CASE WHEN ({_REASON}) IS NULL THEN 'ok' ELSE 'quarantined' END AS status FROM events""")
def _(spark, d):
    stored = table(spark, d, "events").filter("value >= 2").select(
        F.col("event_id").alias("raw_item_id"), (F.col("user_id") % 5).cast("int").alias("attempts"), F.lit("ok").alias("status")
    )
    return gates.save_enrichment(stored, gates.validate_enrichment(completions(spark, d)))


_WORK_SQL = """ok AS (SELECT event_id AS raw_item_id, ts AS fetched_at, CASE WHEN user_id % 23 <> 0 THEN ts END AS published_at, user_id FROM events WHERE value >= 1),
tried AS (SELECT event_id AS raw_item_id, ts - INTERVAL (CASE WHEN user_id % 3 = 0 THEN 10 ELSE 0 END) SECOND AS created, CASE WHEN user_id % 4 = 0 THEN 'quarantined' ELSE 'ok' END AS status FROM events WHERE value >= 2)"""


def work_rows(spark, d):
    """Shown items, and what an earlier run derived from some of them."""
    e = table(spark, d, "events")
    u = F.col("user_id")
    ok = e.filter("value >= 1").select(F.col("event_id").alias("raw_item_id"), F.col("ts").alias("fetched_at"), F.when(u % 23 != 0, F.col("ts")).alias("published_at"))
    late = F.make_dt_interval(secs=F.when(u % 3 == 0, F.lit(10)).otherwise(F.lit(0)))
    tried = e.filter("value >= 2").select(
        F.col("event_id").alias("raw_item_id"), (F.col("ts") - late).alias("created_at"), F.when(u % 4 == 0, "quarantined").otherwise("ok").alias("status"), (u % 5).alias("attempts")
    )
    return ok, tried


@query("e1_pending_embed", f"""WITH {_WORK_SQL} SELECT raw_item_id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, raw_item_id) AS position
FROM ok LEFT JOIN tried USING (raw_item_id) WHERE created IS NULL OR floor(epoch_ms(created) / 1000) < floor(epoch_ms(fetched_at) / 1000)""")
def _(spark, d):
    ok, tried = work_rows(spark, d)
    return gates.with_positions(gates.pending(ok, tried, retry_quarantined=False)).select("raw_item_id", "position")


@query("j2_pending_diff", f"""WITH {_WORK_SQL} SELECT raw_item_id, row_number() OVER (ORDER BY published_at ASC NULLS FIRST, raw_item_id) AS position,
  CASE WHEN created IS NULL THEN 'missing' WHEN floor(epoch_ms(created) / 1000) < floor(epoch_ms(fetched_at) / 1000) THEN 'stale' ELSE 'retry' END AS pending_reason
FROM ok LEFT JOIN tried USING (raw_item_id) WHERE created IS NULL OR floor(epoch_ms(created) / 1000) < floor(epoch_ms(fetched_at) / 1000) OR status = 'quarantined'""")
def _(spark, d):
    ok, tried = work_rows(spark, d)
    listed = gates.with_positions(gates.pending(ok, tried, max_attempts=None), newest_first=False)
    return listed.select("raw_item_id", "position", "pending_reason")


@query("p14_explicit_ids_oldest_first", f"""WITH {_WORK_SQL} SELECT raw_item_id, row_number() OVER (ORDER BY published_at ASC NULLS FIRST, raw_item_id) AS position
FROM ok WHERE raw_item_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, d):
    ok, _ = work_rows(spark, d)
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("raw_item_id"))
    return gates.with_positions(gates.by_ids(ok, ids), newest_first=False).select("raw_item_id", "position")


@query("p14_explicit_ids", f"WITH {SIGNALS_SQL} SELECT id AS raw_item_id, category FROM signals WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("raw_item_id"))
    return gates.by_ids(enriched(spark, d).filter("status = 'ok'"), ids).select("raw_item_id", "category")


@query("e6_change_verdict", """
SELECT event_id, CASE user_id % 6 WHEN 1 THEN 'evidence was not shown' WHEN 2 THEN 'claims a prior state without a prior item'
    WHEN 3 THEN 'schema mismatch — kind: not an allowed value' WHEN 4 THEN 'schema mismatch — before: expected a non-empty string' END AS reject_reason,
  CASE user_id % 6 WHEN 0 THEN 'update' WHEN 5 THEN 'new' END AS kind, CASE user_id % 6 WHEN 0 THEN user_id::VARCHAR WHEN 5 THEN '' END AS evidence FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    k, uid, eid = F.col("user_id") % 6, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kind = F.when(k == 3, "rumour").when(k == 5, "new").otherwise("update")
    evidence = F.when(k == 1, F.concat(uid, F.lit(",999999999"))).when(k == 2, eid).when(k == 5, "").otherwise(uid)
    raw = F.concat(
        F.lit('{"kind":"'), kind, F.lit('","dimension":"pricing","before":'), F.when(k == 4, '""').otherwise("null"),
        F.lit(',"after":"a","materiality":3,"rationale":"r","evidence_item_ids":['), evidence, F.lit("]}"),
    )
    trigger = F.when(k == 2, F.col("event_id")).otherwise(F.lit(-1))
    rows = e.select("event_id", trigger.alias("trigger"), raw.alias("raw"), F.array("event_id", "user_id").alias("shown"))
    v = gates.validate_change(rows, "raw", "shown", "trigger")
    return v.select("event_id", "reject_reason", F.col("verdict.kind").alias("kind"), F.array_join("verdict.evidence_item_ids", ",").alias("evidence"))


def turn_pairs(spark, d):
    """Each assistant turn with the user turn before it."""
    c = table(spark, d, "conversations")
    a = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    return c.select("conv_id", "turn", F.col("text").alias("b")).join(a, ["conv_id", "turn"])


TURN_PAIRS_SQL = """pairs AS (SELECT l.conv_id, r.turn, l.text AS a, r.text AS b FROM conversations l JOIN conversations r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1)"""


@query("e7_conflict_verdict", f"""
WITH {TURN_PAIRS_SQL}, q AS (SELECT *, substr({sql_collapse('a')}, 1, 12) AS qa, substr({sql_collapse('b')}, 1, 12) AS qb FROM pairs)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN false WHEN 1 THEN CASE WHEN length(trim(qa)) >= 3 AND length(trim(qb)) >= 3 THEN true END
  WHEN 2 THEN NULL ELSE CASE WHEN contains({sql_fold('b')}, {sql_fold('qa')}) AND length({sql_collapse('qa')}) >= 3
    AND contains({sql_fold('a')}, {sql_fold('qa')}) THEN true END END AS judged FROM q""")
def _(spark, d):
    p = turn_pairs(spark, d)
    qa, qb = F.substring(collapse(F.col("a")), 1, 12), F.substring(collapse(F.col("b")), 1, 12)
    k = F.col("turn") % 4
    reply = F.when(k == 2, F.lit("{}")).otherwise(
        F.to_json(
            F.struct(
                F.when(k == 0, "consistent").otherwise("contradict").alias("verdict"), qa.alias("evidenceA"),
                F.when(k == 3, qa).otherwise(qb).alias("evidenceB"),
            )
        )
    )
    return gates.validate_conflict(p.withColumn("raw", reply), "raw", "a", "b").select("conv_id", "turn", "judged")


def drafted_briefs(spark, d):
    """One drafted brief per document pair, with sound and broken citations, quotes and conflicts."""
    docs = table(spark, d, "documents")
    nxt = docs.select((F.col("doc_id") - 1).alias("brief_id"), F.col("text").alias("next_text"))
    pairs = docs.select(F.col("doc_id").alias("brief_id"), "text", "lang").join(nxt, "brief_id")
    claim = lambda t, i, q: F.struct(F.lit(t).alias("text"), i.alias("sourceId"), q.alias("quote"))
    quote, other = F.substring(collapse(F.col("text")), 1, 30), F.substring(collapse(F.col("next_text")), 1, 30)
    own, nxt_id = F.col("brief_id"), F.col("brief_id") + 1
    claims = F.array(claim("c", own, F.when(F.col("lang") == "de", "never said in the text").otherwise(quote)))
    second = F.when(F.col("lang") == "es", own).otherwise(nxt_id)
    sides = F.array(claim("x", own, quote), claim("y", second, F.when(F.col("lang") == "es", quote).otherwise(other)))
    conflicts = F.array(F.struct(F.lit("t").alias("topic"), sides.alias("sides"), F.lit("n").alias("note")))
    draft = F.struct(
        F.concat(F.lit("Summary [#"), F.when(F.col("lang") == "fr", F.lit("99999999")).otherwise(own.cast("string")), F.lit("]")).alias("summary"),
        claims.alias("claims"), conflicts.alias("conflicts"),
    )
    drafts = pairs.select("brief_id", F.to_json(draft).alias("draft_json"))
    sources = pairs.select("brief_id", F.col("brief_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content")).unionByName(
        pairs.select("brief_id", nxt_id.alias("id"), F.lit("").alias("title"), F.col("next_text").alias("content"))
    )
    return drafts, sources


@query("e8_c8_brief_draft_audit", f"""
WITH p AS (SELECT a.doc_id AS brief_id, a.lang, substr({sql_collapse('a.text')}, 1, 30) AS q, substr({sql_collapse('b.text')}, 1, 30) AS o
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
s AS (SELECT *, length(q) >= 1 AND length(o) >= 1 AS shaped FROM p)
SELECT brief_id, shaped, shaped AND lang = 'en' AND length(trim(q)) >= 8 AND length(trim(o)) >= 8 AS grounded FROM s""")
def _(spark, d):
    drafts, sources = drafted_briefs(spark, d)
    v = gates.audit_draft(gates.validate_brief_draft(drafts), sources)
    return v.select("brief_id", F.col("draft").isNotNull().alias("shaped"), "grounded")


@query("e9_e10_cell_draft", """
SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'strong' ELSE 'info' END AS level, CASE user_id % 5 WHEN 0 THEN 'Better [#' || event_id || ']' ELSE 'kept' END AS note FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    k, eid = F.col("user_id") % 5, F.col("event_id").cast("string")
    raw = F.concat(
        F.lit('```json {"level":"'), F.when(k == 1, "superb").otherwise("strong"), F.lit('","note":"Better'),
        F.when(k == 2, "").when(k == 3, F.concat(F.lit(" [#"), eid, F.lit("] [#999999999]"))).otherwise(F.concat(F.lit(" [#"), eid, F.lit("]"))),
        F.lit('"'), F.when(k == 4, "").otherwise("}"), F.lit(" ```"),
    )
    v = gates.validate_cell_draft(e.select("event_id", raw.alias("raw")), "raw", "event_id")
    kept = F.struct(F.lit("info").alias("level"), F.lit("kept").alias("note"))
    cell = gates.accept_or_fallback(F.col("drafted"), F.col("drafted").isNotNull(), kept)
    return v.select("event_id", cell.alias("c")).select("event_id", "c.level", "c.note")
