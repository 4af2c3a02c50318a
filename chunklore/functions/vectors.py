"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """Divided by its length; a zero vector by 1e-9."""
    return F.transform(F.array(F.when(norm(a) == 0, F.lit(1e-9)).otherwise(norm(a))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """Zero where either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def z_sigmoid(value: Column, mean: Column, deviation: Column, tau: float) -> Column:
    """The logistic of the standardised value over ``tau``."""
    return 1 / (1 + F.exp(-((value - mean) / (deviation + 1e-9)) / tau))
