"""Vector arithmetic on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - a.b / (|a||b|)``; a zero vector is at distance 1 from everything."""
    norms = l2_norm(a) * l2_norm(b)
    return F.lit(1.0) - F.when(norms > 0, _dot(a, b) / norms).otherwise(0.0)
