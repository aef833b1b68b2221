"""Vectors as arrays, for expressions; bulk work is in `operators.similarity`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit length; a vector without length stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / (n + 1e-10))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing or has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)
