"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tidewatch.session import build_session

HEADLINES = [
    "j1_r1_r2_r3_ranked_brief",
    "a1_p7_vendor_roster",
    "r10_related_signals",
    "n1_normalise",
    "n3_first_wins_dedupe",
    "n4_n5_upsert_classify",
    "n6_rollup_lineitem",
    "v1_v2_chunks",
    "v6_v7_bm25_top_k",
    "v3_nearest_vectors",
    "d1_sentence_diff",
    "d5_fact_chain",
    "c1_c5_contradiction",
    "m2_m3_j10_r8_suggestions",
    "j9_r6_digest_rows",
    "w4_rate_windows",
    "w1_continuous_ingest",
    "e2_e3_validate_enrichment",
    "b2_battlecards",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidewatch-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidewatch-bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidewatch.plans import QUERIES

    names = sys.argv[1:] or HEADLINES
    # One untimed pass over a small table starts the JVM's and the Python workers' machinery.
    QUERIES["x4_content_hash"](spark, sf_dir).limit(1).collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
        )
    )


if __name__ == "__main__":
    main()
