"""Queries that hold all their rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidewatch.operators import gates
from tidewatch.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TIDEWATCH_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def test_golden_evaluation_holds_every_labelled_pair(spark):
    name = "d10_golden_evaluation"
    assert compare(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id").join(labels, "doc_id").count()
    assert sum(r.n for r in QUERIES[name](spark, SF_DIR).where("expected <> 'all'").collect()) == pairs


@pytest.mark.parametrize("name", ["e1_pending_embed", "j2_pending_diff", "p14_explicit_ids_oldest_first", "r4_feed_order_title"])
def test_lists_are_whole(spark, name):
    assert compare(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None
    places = [r[0] for r in QUERIES[name](spark, SF_DIR).select("place" if name.startswith("r4") else "position").collect()]
    assert sorted(places) == list(range(1, len(places) + 1)) and len(places) > 500


@pytest.mark.parametrize("newest_first", [True, False])
def test_positions_over_many_ranges(spark, newest_first):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 50) for i in range(1000)]
    frame = spark.createDataFrame(rows, "raw_item_id long, published_at long").repartition(5)
    got = {r.raw_item_id: r.position for r in gates.with_positions(frame, newest_first=newest_first).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]) if newest_first else (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: n for n, r in enumerate(order, 1)}
