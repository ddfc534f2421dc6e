from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import ingest as ing
from tidewatch.operators import sinks
from tidewatch.sources import payloads as pay


def sequential_first_wins(rows):
    seen_a, seen_b, kept = set(), set(), []
    for seq, a, b in sorted(rows):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            kept.append(seq)
    return kept


def test_first_wins_matches_the_sequential_rule(spark):
    rng = random.Random(7)
    batches = []
    for scope in range(12):
        batches += [(scope, i, f"u{rng.randrange(9)}", f"c{rng.randrange(9)}") for i in range(40)]
    # A hot url with many bodies and a long chain of alternating collisions.
    batches += [(99, i, "hot", f"c{i}") for i in range(30)]
    batches += [(98, i, f"u{(i + 1) // 2}", f"c{i // 2}") for i in range(20)]
    df = spark.createDataFrame(batches, "scope int, seq int, url_hash string, content_hash string")
    kept = {(r.scope, r.seq) for r in ing.first_wins(df, "seq", ["scope"]).collect()}
    want = set()
    for scope in {b[0] for b in batches}:
        want |= {(scope, s) for s in sequential_first_wins([b[1:] for b in batches if b[0] == scope])}
    assert kept == want


BASE = "source_id string, canonical_url string, url_hash string, external_id string, url string, content_hash string, title string, author string, content string, published_at timestamp, fetched_at timestamp"


def base_row(u, c):
    return ("s", u, u, None, u, c, "t", None, c, None, None)


def test_upsert_is_idempotent_and_keeps_pre_images(spark):
    base = spark.createDataFrame([base_row("u1", "a"), base_row("u2", "b")], BASE)
    batch = spark.createDataFrame([base_row("u1", "a2") + (1,), base_row("u3", "b") + (2,), base_row("u4", "d") + (3,), base_row("u2", "b") + (4,)], BASE + ", seq int")
    new, revisions, classified = ing.upsert(base, batch, F.lit("2024-01-01").cast("timestamp"))
    assert {(r.url_hash, r.status) for r in classified.collect()} == {("u1", "revised"), ("u3", "duplicate"), ("u4", "inserted"), ("u2", "unchanged")}
    assert {(r.url_hash, r.content_hash) for r in new.collect()} == {("u1", "a2"), ("u2", "b"), ("u4", "d")}
    assert [(r.url_hash, r.content_hash) for r in revisions.collect()] == [("u1", "a")]
    again = {r.status for r in ing.classify_upsert(new, batch).collect()}
    assert again == {"unchanged", "duplicate"}


def test_twin_revised_away_earlier_in_the_batch_is_no_twin(spark):
    base = spark.createDataFrame([base_row("u1", "a")], BASE)
    first = spark.createDataFrame([base_row("u1", "z") + (1,), base_row("u9", "a") + (2,)], BASE + ", seq int")
    later = spark.createDataFrame([base_row("u9", "a") + (1,), base_row("u1", "z") + (2,)], BASE + ", seq int")
    assert {r.url_hash: r.status for r in ing.classify_upsert(base, first).collect()} == {"u1": "revised", "u9": "inserted"}
    assert {r.url_hash: r.status for r in ing.classify_upsert(base, later).collect()} == {"u1": "revised", "u9": "duplicate"}


def test_first_wins_has_no_bound_on_chains_or_groups(spark):
    chain = [(i, f"u{(i + 1) // 2}", f"c{i // 2}") for i in range(5_000)]
    hot = [(10_000 + i, "hot", f"b{i}") for i in range(5_000)]
    rng = random.Random(5)
    mixed = [(20_000 + i, f"m{rng.randrange(40)}", f"n{rng.randrange(40)}") for i in range(400)]
    rows = chain + hot + mixed
    df = spark.createDataFrame(rows, "seq long, url_hash string, content_hash string").repartition(4)
    assert sorted(r.seq for r in ing.first_wins(df, "seq").collect()) == sequential_first_wins(rows)


def test_long_bodies_and_full_sources_arrive_whole(spark):
    body = "word " * 6_000
    payload = f"<rss><channel><item><title>t</title><link>https://x.com/1</link><description>{body}</description></item></channel></rss>"
    feed = spark.createDataFrame([(1, payload)], "source_id int, payload string")
    assert len(pay.feed_items(feed).first().content) == len(body.strip())
    assert len(pay.feed_items(feed, max_chars=100).first().content) <= 101
    start = datetime(2024, 1, 1, tzinfo=UTC)
    items = spark.createDataFrame([(1, i, start + timedelta(minutes=i // 2)) for i in range(200)] + [(1, 200, None)], "source_id int, position int, published_at timestamp")
    cursors = spark.createDataFrame([(1, start - timedelta(days=1))], "source_id int, since timestamp")
    assert pay.incremental(items, cursors).count() == 201
    # With a limit the cursor follows what was taken, so further runs bring the rest.
    sources, seen = spark.createDataFrame([(1, start - timedelta(days=1))], "source_id int, last_fetched_at timestamp"), set()
    report = spark.createDataFrame([(1, "ok")], "source_id int, status string")
    for _ in range(5):
        taken = pay.incremental(items, sources.select("source_id", F.col("last_fetched_at").alias("since")), limit=51)
        got = [r.position for r in taken.collect()]
        assert not set(got) & (seen - {200})
        seen |= set(got)
        sources = spark.createDataFrame(pay.advance_cursor(sources, report, F.lit(start + timedelta(days=9)), taken).collect(), sources.schema)
    assert seen == set(range(201))


def test_catalog_sync_keeps_operator_fields(spark):
    stored = spark.createDataFrame([("rss", "u", "old", "v", None, False, None)], "kind string, url string, name string, vendor string, config string, enabled boolean, last_fetched_at timestamp")
    catalog = spark.createDataFrame([("rss", "u", "new", None, "{}"), ("hn", "w", "n2", None, None)], "kind string, url string, name string, vendor string, config string")
    got = {r.url: (r.name, r.vendor, r.enabled) for r in sinks.sync_catalog(stored, catalog).collect()}
    assert got == {"u": ("new", None, False), "w": ("n2", None, True)}


def test_feed_dialects(spark):
    rss = (
        '<rss version="2.0"><channel><item><title>A &amp;amp; B</title><link>https://x.com/1</link><guid>g1</guid>'
        "<description>short</description><content:encoded><![CDATA[<p>Long</p>]]></content:encoded><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"
        "<item><title>no link</title><guid>not-a-url</guid></item></channel></rss>"
    )
    atom = '<feed><entry><title>T</title><link rel="enclosure" href="http://e"/><link rel="alternate" href="http://a"/><id>i</id><summary>S</summary><updated>2024-01-01T00:00:00Z</updated><author><name>Al</name></author></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "<html>broken")], "source_id int, payload string")
    rows = {(r.source_id, r.position): r for r in pay.feed_items(df).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)}
    assert (rows[1, 0].title, rows[1, 0].content, rows[1, 0].external_id, rows[1, 0].reject_reason) == ("A & B", "Long", "g1", None)
    assert rows[1, 1].reject_reason is not None
    assert (rows[2, 0].url, rows[2, 0].author, rows[2, 0].content) == ("http://a", "Al", "S")


def test_rate_windows_follow_the_chain(spark):
    from tidewatch.operators.rate import rate_limit

    rng = random.Random(3)
    rows, want, n = [], {}, 0
    for key in ("hot", "a", "b"):
        start, seen, ms = None, 0, 0
        for _ in range(400 if key == "hot" else 30):
            ms += rng.choice([0, 3, 40, 200, 999])
            if start is None or ms >= start + 1000:
                start, seen = ms, 0
            seen += 1
            rows.append((n, key, ms))
            want[n] = (start, seen <= 5)
            n += 1
    df = spark.createDataFrame(rows, "event_id long, k string, ms long").select("event_id", "k", F.timestamp_millis("ms").alias("at"))
    out = rate_limit(df, "k", "at", "event_id", 1000, 5)
    assert {r[0]: (r[1], r[2]) for r in out.select("event_id", F.unix_millis("window_start"), "allowed").collect()} == want
