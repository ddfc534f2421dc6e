from __future__ import annotations

import json

from tidewatch.operators.evidence import full_grid
from tidewatch.sources import assets

CELL = {"level": "strong", "note": "n"}
MATRIX = {
    "focusVendor": "Ours",
    "vendors": [{"name": "Ours", "slug": "ours"}, {"name": "Them", "slug": "them"}],
    "axes": [
        {"id": "a", "label": "A", "description": "d", "categories": ["Product"], "cells": {"Ours": CELL, "Them": {"level": "great", "note": "n"}}},
        {"id": "b", "label": "B", "description": "d", "categories": [], "cells": {}},
    ],
}


def test_matrix_file(spark, tmp_path):
    path = tmp_path / "matrix.json"
    path.write_text(json.dumps(MATRIX, indent=2))
    matrix = assets.read_matrix(spark, str(path))
    assert {(r["where"], r.problem) for r in assets.matrix_problems(matrix).collect()} == {("Them::a", "level or note"), ("b", "axis")}
    assert {(r.vendor, r.is_focus) for r in assets.matrix_vendors(matrix).collect()} == {("Ours", True), ("Them", False)}
    assert full_grid(matrix).count() == 4


def test_change_pairs_file(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps([{"id": "x", "prior": None, "next": "n", "expectedKind": "new"}, {"id": "y", "prior": "p", "next": "n", "revised": True, "expectedKind": "update"}]))
    rows = {r.id: (r.prior, r.revised, r.expectedKind) for r in assets.read_change_pairs(spark, str(path)).collect()}
    assert rows == {"x": (None, None, "new"), "y": ("p", True, "update")}
