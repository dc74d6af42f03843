"""Expressions over scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(score: Column) -> Column:
    """A score within 0 and 1; null for null and for what is no number."""
    return F.when(~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
