"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(a: Column) -> Column:
    """Unit length; all zeros where the length is below 1e-6."""
    # bound by a lambda, the length is not taken anew for each component
    unit = lambda length: F.transform(a, lambda x: F.when(length < 1e-6, 0.0).otherwise(x.cast("double") / length))
    return F.transform(F.array(F.sqrt(dot(a, a))), unit)[0]


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, clipped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(cosine(a, b), F.lit(0.0))))
