"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero when either vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def unit(a: Column) -> Column:
    """Scaled to length one, so that later cosines are plain dot products."""
    length = F.sqrt(dot(a, a))
    return F.transform(
        a, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length)
    )
