"""Plan-shape helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A filter on a computed column is normally pushed below the projection that computes it, which
    copies the expression into the filter, and a chain of costly columns is copied again at every
    reference. A generator stops that: the values below it are computed once and read from then on.
    """
    keep = [c for c in df.columns if c not in columns]
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))
