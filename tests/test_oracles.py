"""Registered queries against their oracles on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.oracle import compare, connect
from tidewatch.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TIDEWATCH_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

# One query per family; `python -m tests.check <sf_dir>` runs all of them.
SAMPLE = [
    "j1_r1_r2_r3_ranked_brief", "x3_x5_canonical_url", "s1_feed_items", "n3_first_wins_dedupe", "n4_n5_upsert_classify", "e2_e3_validate_enrichment",
    "v1_v2_chunks", "d4_j5_a8_similar_priors", "d7_d8_change_events", "c1_c5_contradiction", "m2_m3_j10_r8_suggestions", "b2_battlecards", "t3_digests",
    "w1_continuous_ingest", "w3_fact_stream", "w4_rate_stream", "d5_two_passes", "d6_fact_held_at_each_item", "j11_approval_at_each_review", "s14_markdown",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sample_is_registered():
    assert set(SAMPLE) <= set(QUERIES) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None
