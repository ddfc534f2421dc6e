"""State of streams over several micro-batches, and blocks that a nearest-neighbour search doesn't open."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evidence, neighbours
from tidewatch.session import run_dir
from tidewatch.streaming import ingest, state


def _land(spark, stream_of, batches, schema):
    """Each batch as a micro-batch of its own; (rows written, rows of state after each)."""
    folder = run_dir(spark, "stream")
    held = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        stream = stream_of(ingest.landed(spark, f"{folder}/landed", spark.createDataFrame([], schema).schema))
        run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.parquet(f"{folder}/out"), held


def test_rate_state_is_empty_after_the_last_window(spark):
    state.use_rocksdb(spark)
    batches = [
        [(1, "a", 0.0), (2, "a", 30.0), (3, "b", 50.0), (4, "a", 59.0)],
        [(6, "a", 61.0), (5, "a", 45.0), (7, "b", 200.0)],
        [(-1, None, 9000.0)],
    ]
    start = lambda rows: state.rate_stream(rows.withColumn("at", F.timestamp_seconds(F.col("s") + 6000)), "key", "at", "id", width=60_000, budget=2, delay="1 minute")
    out, held = _land(spark, start, batches, "id long, key string, s double")
    got = {r.event_id: (r.window_ms - 6_000_000, r.allowed) for r in out.collect()}
    assert got == {1: (0, True), 2: (0, True), 5: (0, False), 4: (0, False), 6: (61_000, True), 3: (50_000, True), 7: (200_000, True)}
    assert held[0] > 0 and held[-1] == 0


def test_facts_that_come_late_are_put_between(spark):
    state.use_rocksdb(spark)
    row = lambda i, kind, minute: (i, "v", "d", kind, f"text {i}", minute * 60.0)
    batches = [
        [row(1, "new", 0), row(3, "update", 20)],
        [row(2, "update", 10), row(4, "new", 40)],
        [row(6, "update", 300), row(5, "update", 50)],
        [row(7, "update", 320)],
    ]
    start = lambda rows: state.fact_stream(rows.withColumn("at", F.timestamp_seconds(F.col("s") + 6000)).drop("s"), "1 hour")
    told, _ = _land(spark, start, batches, "item_id long, vendor string, dimension string, kind string, after string, s double")
    got = {r.fact_id: (r.fact, r.previous_fact_id, r.superseded_by) for r in state.latest_facts(told).collect()}
    assert got == {
        1: ("text 1", None, 2), 2: ("text 2", 1, 3), 3: ("text 3", 2, None), 4: ("text 4", None, 5),
        5: ("text 5", 4, 6), 6: ("text 6", 5, 7), 7: ("text 7", 6, None),
    }
    assert told.filter("fact_id = 3").count() > 1  # corrected when its predecessor came


def clustered(spark, clusters=12, size=40, width=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(clusters, width))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), size, axis=0) + rng.normal(scale=0.01, size=(clusters * size, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, i // 2, "g", v[i].tolist(), bool(i % 5 == 0)) for i in range(len(v))]
    return v, spark.createDataFrame(rows, "chunk_id long, item_id long, g string, vector array<double>, flag boolean")


def test_far_blocks_are_not_opened(spark):
    v, corpus = clustered(spark)
    queries = corpus.select(F.col("chunk_id").alias("query_id"), F.col("item_id").alias("self_item"), "g", "vector")
    left, right = neighbours._sides(queries, corpus, "g", None, 7, 32, 30)
    assert left.blocks.agg(F.max("n")).first()[0] <= 64
    pairs = neighbours.block_pairs(left.blocks, right.blocks, None)
    search = neighbours._search(5, "", 0, None, False, False)
    _, rest, _ = neighbours.closest_first(left, pairs, 5, lambda some: neighbours._searched(left, right, some, search, []), False)
    opened = rest.count() + left.blocks.count()
    assert opened < 0.5 * pairs.count()

    similarity = np.round(1 - ((v[:, None] - v[None]) ** 2).sum(-1) / 2, 9)
    item = np.arange(len(v)) // 2
    want = {i: [j for j in np.lexsort((np.arange(len(v)), -similarity[i])) if item[j] != item[i]][:5] for i in range(len(v))}
    got = {}
    for r in neighbours.nearest(queries, corpus, 5, group="g", block_rows=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want


@pytest.mark.parametrize("block_rows", [6, 4096])
def test_counts_and_best_come_from_one_search(spark, block_rows):
    v, corpus = clustered(spark)
    queries = corpus.select(F.col("chunk_id").alias("query_id"), F.col("item_id").alias("self_item"), "g", "vector")
    counted, best = neighbours.within(queries, corpus, 0.9, 3, group="g", block_rows=block_rows)
    similarity = np.round(1 - ((v[:, None] - v[None]) ** 2).sum(-1) / 2, 9)
    item = np.arange(len(v)) // 2
    for r in counted.collect():
        hits = [j for j in range(len(v)) if item[j] != item[r.query_id] and similarity[r.query_id, j] >= 0.9]
        assert (r.n, r.flagged) == (len({item[j] for j in hits}), any(j % 5 == 0 for j in hits)) and r.best == max(similarity[r.query_id, j] for j in hits)
    assert counted.count() == len(v) and best.groupBy("query_id").count().agg(F.min("count"), F.max("count")).first()[:] == (3, 3)
    left, right = neighbours._sides(queries, corpus, "g", None, 7, 6, 30, by_item=True, extra=["flag"])
    pairs = neighbours.block_pairs(left.blocks, right.blocks, None)
    assert pairs.filter(neighbours._reaches(F.lit(0.9))).count() < 0.5 * pairs.count()


def test_corroboration_counts_and_lists_alike(spark):
    _, corpus = clustered(spark, clusters=3, size=8)
    signals = corpus.select(F.col("item_id").alias("raw_item_id"), F.col("g").alias("vendor"), F.lit("secondary").alias("tier"), F.lit(None).cast("timestamp").alias("at"), "vector").dropDuplicates(["raw_item_id"])
    rows = corpus.select("chunk_id", "item_id", F.col("g").alias("vendor"), F.when(F.col("flag"), "primary").otherwise("secondary").alias("tier"), F.lit(None).cast("timestamp").alias("at"), "vector")
    verdict, matches = evidence.corroborate(signals, rows, 0.9)
    listed = {r.query_id: r["count"] for r in matches.groupBy("query_id").count().collect()}
    assert {r.raw_item_id: r.corroborators for r in verdict.collect()} == listed and set(listed.values()) == {3}
