"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / length)
    )


def pad(v: Column, width: int) -> Column:
    doubles = F.transform(v, lambda x: x.cast("double"))
    return F.concat(doubles, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(v))))


def l2_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x))


def cosine_from_l2(distance: Column) -> Column:
    """Exact for unit vectors."""
    return F.lit(1.0) - distance * distance / 2
