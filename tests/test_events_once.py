"""Change events are made once for all that reads them."""

from __future__ import annotations

import datetime as dt

import pytest

from tidewatch.plans import QUERIES


@pytest.mark.parametrize("name", ["p3_changes_vendor_case", "j4_a4_changes_feed"])
def test_events_are_made_once(spark, name, monkeypatch, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 2), 4, "purchase", 1.05, "{}"), (2, dt.datetime(2024, 1, 3), 25, "click", 2.15, "{}"), (3, dt.datetime(2024, 1, 4), 34, "error", 1.25, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    made = QUERIES[name](spark, str(tmp_path))
    assert not [f for f in made.inputFiles() if "/events.parquet/" in f or "change-rows" in f]
