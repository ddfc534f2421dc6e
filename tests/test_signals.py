from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import changes, chunking, contradiction, evidence, gates, neighbours, search


def chunk_by_hand(text, target=220, limit=320, overlap=40):
    import math
    import re

    size = lambda s: max(1, math.ceil(len(s.split()) * 1.3))
    flat = " ".join(text.split())
    parts = []
    for s in [s for s in re.split(r"(?<=[.!?]) ", flat) if s]:
        words = s.split(" ")
        parts += [s] if size(s) <= limit else [" ".join(words[i : i + 246]) for i in range(0, len(words), 246)]
    out, cur = [], []
    total = 0
    for s in parts:
        if cur and total + size(s) > target:
            out.append(" ".join(cur))
            tail, budget = [], overlap
            for x in reversed(cur):
                if budget <= 0:
                    break
                tail.insert(0, x)
                budget -= size(x)
            cur, total = tail, sum(size(x) for x in tail)
        cur.append(s)
        total += size(s)
    return out + ([" ".join(cur)] if cur else [])


def test_chunks_match_the_greedy_rule(spark):
    rng = random.Random(5)
    texts = ["", "  ", "One.", " ".join(["w"] * 700)]
    for _ in range(12):
        texts.append("\n".join(" ".join(["word"] * rng.choice([1, 3, 12, 40, 90, 260])) + rng.choice(".!?") for _ in range(rng.randrange(1, 60))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in chunking.chunk(df, F.col("t")).orderBy("i", "chunk_index").collect():
        got.setdefault(r.i, []).append(r.content)
    assert got == {i: chunk_by_hand(t) for i, t in enumerate(texts) if chunk_by_hand(t)}


@pytest.mark.parametrize(
    "a,b,fires",
    [
        ("Acme supports air-gapped deploys today", "Acme does not support air-gapped deploys", True),
        ("Acme raised platform pricing", "Acme platform pricing stayed flat", True),
        ("Acme revenue grew 20% this year", "Acme revenue grew 10% this year", True),
        ("Acme launches the scanner product", "Acme scanner product discontinued", True),
        ("Acme launches the scanner", "Acme scanner now covers images", False),
        ("Totally unrelated words", "Nothing in common here", False),
        ("Pricing raised then cut for Acme tiers", "Acme tiers pricing flat", False),
    ],
)
def test_contradiction(spark, a, b, fires):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert contradiction.detect(df, "a", "b").first().contradicts is fires


def test_percent_also_counts_as_version(spark):
    df = spark.createDataFrame([("Acme growth hit 12.5% here", "Acme growth hit 13.5% here")], "a string, b string")
    assert contradiction.detect(df, "a", "b").first().signals == ["percentages differ: 12.5 vs 13.5", "versions differ: 12.5 vs 13.5"]


def test_formatting_only_revision_is_a_duplicate(spark):
    d = changes.sentence_diff(F.lit("A released 1.2. It adds SBOM export."), F.lit("A  RELEASED 1.2.\nIt adds SBOM export."))
    assert spark.range(1).select(d.alias("d")).first().d.asDict() == {"removed": [], "added": []}


def test_fact_chain_equals_a_mutable_replay(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    rows, current, want = [], {}, {}
    for i in range(300):
        key = (rng.choice("ab"), rng.choice(["pricing", "release"]))
        kind = rng.choice(["new", "update", "rephrase"])
        rows.append((i, *key, kind, f"f{i}", start + dt.timedelta(hours=i * 7)))
        if kind == "rephrase":
            continue
        prior = current.get(key) if kind == "update" else None
        want[i] = [prior, None]
        if prior is not None:
            want[prior][1] = i
        current[key] = i
    df = spark.createDataFrame(rows, "item_id long, vendor string, dimension string, kind string, after string, at timestamp")
    got = {r.fact_id: [r.previous_fact_id, r.superseded_by] for r in changes.fact_chain(df).collect()}
    assert got == want


def test_bm25_phrases_and_top_k(spark):
    chunks = spark.createDataFrame(
        [(1, "Patch for CVE-2026-3199 released"), (2, "2026 has cve news, number 3199"), (3, "nothing here"), (4, "patch patch notes")], "chunk_id long, content string"
    )
    q = spark.createDataFrame([(1, "CVE-2026-3199"), (2, "patch")], "query_id long, text string")
    hits = search.bm25(chunks, search.postings(chunks), search.query_terms(q), k=5).collect()
    assert [r.chunk_id for r in hits if r.query_id == 1] == [1]
    assert [r.chunk_id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == 2] == [4, 1]


def test_nearest_does_not_depend_on_blocks(spark):
    rng = random.Random(2)
    rows = [(i, i, rng.choice("ab"), [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, item long, g string, vector array<double>")
    from tidewatch.functions.vectors import unit

    v = v.withColumn("vector", unit(F.col("vector")))
    q = v.select(F.col("id").alias("query_id"), F.col("item").alias("self_item"), "g", "vector")
    c = v.select(F.col("id").alias("chunk_id"), F.col("item").alias("item_id"), "g", "vector")
    small = {tuple(r) for r in neighbours.nearest(q, c, 4, group="g", block_rows=16).select("query_id", "chunk_id", "rank").collect()}
    large = {tuple(r) for r in neighbours.nearest(q, c, 4, group="g", block_rows=4096).select("query_id", "chunk_id", "rank").collect()}
    assert small == large and len(small) == 480


@pytest.mark.parametrize(
    "reply,ok",
    [
        ('{"category":"Pricing","impact_score":3.0,"summary":"s","why_it_matters":"w"}', True),
        ('```json\n{"category":"Pricing","impact_score":5,"summary":"s","why_it_matters":"w","x":1}\n```', True),
        ('{"category":"Pricing","impact_score":"3","summary":"s","why_it_matters":"w"}', False),
        ('{"category":"Pricing","impact_score":3,"summary":"","why_it_matters":"w"}', False),
        ('{"category":"Pricing","impact_score":3,"summary":"s","why_it_matters":"w","rationale":null}', False),
        ("[]", False),
        ("nope", False),
    ],
)
def test_enrichment_gate(spark, reply, ok):
    df = spark.createDataFrame([(reply,)], "completion string")
    row = gates.validate_enrichment(df).first()
    assert (row.status == "ok") is ok and (row.quarantine_reason is None) is ok


def test_confidence_levels(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    cells = spark.createDataFrame(
        [(0, None, None, None), (3, 5, dt.datetime(2024, 1, 31), True), (1, 4, dt.datetime(2024, 1, 31), False)],
        "evidence_count int, max_impact int, newest_at timestamp, has_primary boolean",
    )
    assert [r.confidence for r in evidence.with_confidence(cells, now).collect()] == ["low", "high", "medium"]


def test_pages_deep_in_an_order_come_from_their_ranges(spark, monkeypatch):
    from tidewatch.operators import ranking

    monkeypatch.setattr(ranking, "FRONT_ROWS", 20)
    rows = spark.range(1_000).select("id", (F.col("id") % 7).alias("impact_score"))
    want = sorted(((r.id, r.impact_score) for r in rows.collect()), key=lambda r: (-r[1], -r[0]))
    for page in (1, 2, 3, 40, 99, 100, 500):
        got = ranking.paginate(rows, [F.desc("impact_score"), F.desc("id")], page, 10)
        start = (min(page, 100) - 1) * 10
        assert [(r.id, r.impact_score) for r in got.collect()] == want[start : start + 10]
    plan = ranking.paginate(rows, [F.desc("impact_score"), F.desc("id")], 40, 10)._jdf.queryExecution().executedPlan().toString()
    assert "offset" not in plan.lower()


def test_corroborators_are_counted_without_a_bound(spark):
    from tidewatch.operators import evidence

    at = F.lit("2024-01-01").cast("timestamp")
    items = spark.range(200).select(
        F.col("id").alias("raw_item_id"), F.lit("v").alias("vendor"), F.when(F.col("id") == 7, "primary").otherwise("secondary").alias("tier"), at.alias("at"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")
    )
    corpus = items.select(F.col("raw_item_id").alias("chunk_id"), F.col("raw_item_id").alias("item_id"), "vendor", "tier", "at", "vector")
    verdict, listed = evidence.corroborate(items, corpus)
    got = {r.raw_item_id: (r.status, r.corroborators) for r in verdict.collect()}
    assert got[7] == ("primary-source", 199) and got[8] == ("primary-confirmed", 199)
    assert listed.filter("query_id = 8").count() == 30


def test_long_texts_are_split_and_folded_once(spark):
    from tidewatch.operators.changes import sentence_diff

    old = [f"Sentence number {i} stands here." for i in range(6_000)]
    new = [s if i % 3 else s.replace("stands", "sits") for i, s in enumerate(old)]
    row = spark.createDataFrame([(" ".join(old), " ".join(new)), (None, "One. Two."), ("Same.", " same. ")], "a string, b string").select(sentence_diff(F.col("a"), F.col("b")).alias("d")).collect()
    assert (row[0].d.removed, row[0].d.added) == (old[::3], new[::3])
    assert (row[1].d.removed, row[1].d.added) == ([], ["One.", "Two."])
    assert (row[2].d.removed, row[2].d.added) == ([], [])
