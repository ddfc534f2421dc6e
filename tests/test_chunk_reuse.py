"""Queries that use the chunks of every document several times cut the documents once."""

from __future__ import annotations

import pytest

from tidewatch.plans import QUERIES


@pytest.mark.parametrize("name, rows", [("v7_index_sync", {(0, "kept"), (200000, "rebuilt")}), ("v2_replace_item_chunks", {(0, "kept"), (100000, "kept"), (200000, "rebuilt")})])
def test_documents_are_read_once(spark, tmp_path, name, rows):
    docs = [(i, f"Document {i} says a little. It ends here.", "en", "s", 40) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert "documents.parquet" not in out._jdf.queryExecution().toString()
    assert {(r.chunk_id, r.state) for r in out.collect()} == rows
