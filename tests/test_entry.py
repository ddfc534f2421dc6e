"""The driver's entry without the optional part."""

from __future__ import annotations

import importlib
import sys

import pytest


@pytest.mark.parametrize("hidden", ["public_tokenizers", "corpus_pipeline", "sentencepiece", "tidewatch.llm"])
def test_entry_without_a_module_of_the_optional_part(monkeypatch, hidden):
    kept = {n: m for n, m in sys.modules.items() if n.split(".")[0] in ("corpus_pipeline", "__spark_entry__") or n.startswith("tidewatch.llm")}
    for name in kept:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)
    entry = importlib.import_module("__spark_entry__")
    assert "j1_r1_r2_r3_ranked_brief" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
