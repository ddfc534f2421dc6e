"""Streaming jobs run to completion over the test tables, plus the batch rate windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.rate import rate_limit
from tidewatch.plans.ingest import GLOBAL_DEDUPE_SQL
from tidewatch.plans.registry import query
from tidewatch.plans.views import items, table
from tidewatch.operators import ingest as ing
from tidewatch.session import run_dir, settle
from tidewatch.streaming import ingest as flow
from tidewatch.streaming import state
from tidewatch.functions.text import first_sentence

_WIDTH_MS = 6 * 3_600_000
_BUDGET = 2

# The sequential definition: one step per event of a key.
RATE_SQL = f"""ordered AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
walk AS (
  SELECT user_id, n, event_id, ms AS start, 1 AS seen FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.n, o.event_id, CASE WHEN o.ms >= w.start + {_WIDTH_MS} THEN o.ms ELSE w.start END, CASE WHEN o.ms >= w.start + {_WIDTH_MS} THEN 1 ELSE w.seen + 1 END
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.n = w.n + 1)"""


@query("w4_rate_windows", f"WITH RECURSIVE {RATE_SQL} SELECT event_id, start AS window_ms, seen <= {_BUDGET} AS allowed FROM walk")
def _(spark, d):
    out = rate_limit(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", _WIDTH_MS, _BUDGET)
    return out.select("event_id", F.unix_millis("window_start").alias("window_ms"), "allowed")


def _stream(spark, d, name):
    """A table as a stream of its files; zone-less timestamps become UTC instants."""
    path = f"{d}/{name}.parquet"
    rows = flow.landed(spark, path[:-1] + "[t]", spark.read.parquet(path).schema)
    zoneless = [f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else rows


def _drain(stream, folder):
    """Run everything available into Parquet and read it back."""
    run = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def _in_landings(landings, start, folder):
    """Every landing as a micro-batch of its own, resumed from the checkpoint; what the stream has written after the last."""
    for landing in landings:
        landing.write.mode("append").parquet(f"{folder}/landed")
        out = _drain(start(flow.landed(landing.sparkSession, f"{folder}/landed", landing.schema)), folder)
    return out


def _late_landings(rows, at):
    """Three landings; of the first's last 12 hours some rows come with the second, and some of that one's with the third."""
    first, second = (F.lit(t).cast("timestamp") for t in ("2024-01-11", "2024-01-21"))
    twelve = F.expr("interval 12 hours")
    late = F.crc32(F.col(at).cast("string").cast("binary")) % 3 == 0
    due = F.when(F.col(at) < first, F.when(late & (F.col(at) >= first - twelve), 2).otherwise(1)).when(
        F.col(at) < second, F.when(late & (F.col(at) >= second - twelve), 3).otherwise(2)
    ).otherwise(3)
    return [rows.filter(due == n) for n in (1, 2, 3)]


@query("w4_rate_stream", f"WITH RECURSIVE {RATE_SQL} SELECT event_id, start AS window_ms, seen <= {_BUDGET} AS allowed FROM walk")
def _(spark, d):
    """Three landings with late rows, then a row without a key that moves the watermark past the last window."""
    state.use_rocksdb(spark)
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts")
    tick = spark.createDataFrame([(-1, None)], "event_id long, user_id string").withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    start = lambda rows: state.rate_stream(rows, "user_id", "ts", "event_id", _WIDTH_MS, _BUDGET, "24 hours")
    return _in_landings([*_late_landings(e, "ts"), tick], start, run_dir(spark, "rate")).select("event_id", "window_ms", "allowed")


@query("w3_fact_stream", """WITH e AS (SELECT event_id, 'v' || (user_id % 10) AS vendor, event_type AS dimension, props, CASE WHEN floor(value)::BIGINT % 2 = 0 THEN 'new' ELSE 'update' END AS kind, ts FROM events WHERE user_id % 11 <> 0)
SELECT event_id AS fact_id, vendor, dimension, kind, props AS fact, CASE WHEN kind = 'update' THEN lag(event_id) OVER w END AS previous_fact_id, CASE WHEN lead(kind) OVER w = 'update' THEN lead(event_id) OVER w END AS superseded_by
FROM e WINDOW w AS (PARTITION BY vendor, dimension ORDER BY ts, event_id)""")
def _(spark, d):
    """Three landings with late rows: what the stream has told last is the chain a full replay gives."""
    state.use_rocksdb(spark)
    u = F.col("user_id")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("item_id"), F.when(u % 11 != 0, F.concat(F.lit("v"), (u % 10).cast("string"))).alias("vendor"), F.col("event_type").alias("dimension"),
        F.when(F.floor("value") % 2 == 0, "new").otherwise("update").alias("kind"), F.col("props").alias("after"), F.col("ts").alias("at"),
    )
    told = _in_landings(_late_landings(rows, "at"), state.fact_stream, run_dir(spark, "facts"))
    return state.latest_facts(told).select("fact_id", "vendor", "dimension", "kind", "fact", "previous_fact_id", "superseded_by")


@query("w2_reseen_items", "SELECT user_id, event_type, count(DISTINCT user_id || event_type) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    rows = _stream(spark, d, "events").select("user_id", "event_type", F.sha2(F.concat(F.col("user_id").cast("string"), "event_type"), 256).alias("url_hash"), "ts")
    out = _drain(flow.drop_reseen(rows, "ts", "3650 days"), run_dir(spark, "reseen"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("w2_overlap_reread", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """Three landings under a 24 h watermark: the second lands the last hours of the first again, which
    the kept keys drop, and the third all of the first, which is too late by then."""
    e = table(spark, d, "events").select("user_id", "event_type", F.sha2(F.col("event_id").cast("string"), 256).alias("url_hash"), "ts")
    first, second = (F.lit(t).cast("timestamp") for t in ("2024-01-11", "2024-01-21"))
    folder = run_dir(spark, "overlap")
    landings = [
        e.filter(F.col("ts") < first),
        e.filter((F.col("ts") >= first - F.expr("interval 12 hours")) & (F.col("ts") < second)),
        e.filter((F.col("ts") >= second) | (F.col("ts") < first)),
    ]
    for landing in landings:
        landing.write.mode("append").parquet(f"{folder}/landed")
        out = _drain(flow.drop_reseen(flow.landed(spark, f"{folder}/landed", e.schema), "ts", "24 hours"), folder)
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("w1_three_landings", f"""WITH RECURSIVE {GLOBAL_DEDUPE_SQL},
third AS (SELECT CASE WHEN status <> 'duplicate' THEN 'unchanged' WHEN EXISTS (SELECT 1 FROM base t WHERE t.content_hash = c.content_hash AND t.url_hash NOT IN (SELECT url_hash FROM revising)) THEN 'duplicate' ELSE 'inserted' END AS status FROM classified c)
SELECT 0::BIGINT AS landing, 'inserted' AS status, count(*)::BIGINT AS n FROM base
UNION ALL SELECT 1, status, count(*) FROM classified GROUP BY ALL UNION ALL SELECT 2, status, count(*) FROM third GROUP BY ALL""")
def _(spark, d):
    """Labelled documents land first, some under another address or with another wording; then every
    document; then, as in an overlapping fetch, every document again. Each landing is a micro-batch
    of its own, resumed from the checkpoint, that reads the log the ones before it left."""
    raw = items(spark, d).withColumn("published_at", F.lit(None).cast("timestamp"))
    kept = settle(ing.first_wins(settle(ing.accepted(ing.normalise(raw)).select("seq", "url_hash", "content_hash")), "seq").select("seq"))
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("seq"), "toxic", "quality")
    reworded = (F.col("toxic") == 1) | (F.col("quality") == 0)
    earlier = raw.join(kept, "seq").join(lab, "seq").withColumns(
        {"content": F.when(reworded, F.concat("content", F.lit(" reworded"))).otherwise(F.col("content")), "url": F.when(F.col("seq") % 5 == 0, F.concat(F.lit("https://moved.example.com/"), F.sha2("url", 256))).otherwise(F.col("url"))}
    )
    folder = run_dir(spark, "landings")
    for landing in (earlier.select(*raw.columns), raw, raw):
        landing.write.mode("append").parquet(f"{folder}/landed")
        stream = flow.landed(spark, f"{folder}/landed", raw.schema)
        flow.start_ingest(stream, f"{folder}/log", f"{folder}/report", f"{folder}/checkpoint").awaitTermination()
    report = spark.read.parquet(f"{folder}/report")
    return report.groupBy(F.col("batch").cast("bigint").alias("landing"), "status").agg(F.sum("n").alias("n"))


@query("w1_continuous_ingest", f"WITH RECURSIVE {GLOBAL_DEDUPE_SQL} SELECT source_id, url_hash, content_hash FROM batch")
def _(spark, d):
    docs = _stream(spark, d, "documents")
    landed = docs.select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("HTTPS://www.Example.com/"), "source", F.lit("/"), F.col("n_chars").cast("string"), F.lit("/?utm_source=feed&b=2&a=1#top")).alias("url"),
        first_sentence(F.col("text")).alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )
    folder = run_dir(spark, "ingest")
    flow.start_ingest(landed, f"{folder}/log", f"{folder}/report", f"{folder}/checkpoint").awaitTermination()
    return flow.current_items(flow.read_log(spark, f"{folder}/log")).select("source_id", "url_hash", "content_hash")
