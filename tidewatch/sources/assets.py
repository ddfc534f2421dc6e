"""Curated JSON assets: the comparison matrix and labelled change pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import CATEGORIES, CELL_LEVELS, MATRIX_ASSET


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """One row holding the whole asset (it is a small hand-edited document)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", MATRIX_ASSET, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def matrix_axes(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.posexplode("axes").alias("axis_order", "a")).select(
        "axis_order",
        F.col("a.id").alias("axis_id"),
        F.col("a.label").alias("axis_label"),
        F.col("a.description").alias("description"),
        F.col("a.categories").alias("categories"),
    )


def matrix_vendors(matrix: DataFrame) -> DataFrame:
    return matrix.select("focusVendor", F.posexplode("vendors").alias("vendor_order", "v")).select(
        "vendor_order",
        F.col("v.name").alias("vendor"),
        F.col("v.slug").alias("slug"),
        (F.lower("v.name") == F.lower("focusVendor")).alias("is_focus"),
    )


def matrix_cells(matrix: DataFrame) -> DataFrame:
    return (
        matrix.select(F.explode("axes").alias("a"))
        .select(F.col("a.id").alias("axis_id"), F.explode("a.cells").alias("vendor", "cell"))
        .select("axis_id", "vendor", "cell.level", "cell.note")
    )


def matrix_problems(matrix: DataFrame) -> DataFrame:
    """One row per violation of the asset's rules; empty means valid."""
    cells = matrix_cells(matrix)
    levels = cells.filter(~F.col("level").isin(CELL_LEVELS) | (F.coalesce("note", F.lit("")) == "")).select(
        F.concat_ws("::", "vendor", "axis_id").alias("where"), F.lit("level or note").alias("problem")
    )
    axes = matrix_axes(matrix)
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    bad_axes = axes.filter(
        (F.size("categories") == 0)
        | (F.size(F.array_except("categories", names)) > 0)
        | (F.coalesce("axis_label", F.lit("")) == "")
        | (F.coalesce("description", F.lit("")) == "")
    ).select(F.col("axis_id").alias("where"), F.lit("axis").alias("problem"))
    vendors = matrix_vendors(matrix).filter(
        (F.coalesce("vendor", F.lit("")) == "") | (F.coalesce("slug", F.lit("")) == "")
    ).select(F.col("vendor").alias("where"), F.lit("vendor").alias("problem"))
    return levels.unionByName(bad_axes).unionByName(vendors)


def read_change_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled pairs from one JSON array per file, or from one object per line, which splits."""
    schema = "id string, note string, prior string, next string, revised boolean, expectedKind string"
    return spark.read.schema(schema).json(path, multiLine=not lines)
