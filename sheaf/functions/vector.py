"""Vector functions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """The unit vector; zero, null or non-finite vectors end the query."""
    length = norm(v)
    fine = length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf"))
    return F.when(fine, F.transform(v, lambda x: x / length)).otherwise(F.raise_error(F.lit("vector has no direction")).cast("array<double>"))


def problem(v: Column, dimension: int, tolerance: float = 1e-4) -> Column:
    """Why a stored vector is not valid, or null: missing, dimension, not finite, not of unit length."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) != dimension, "dimension").when(~F.coalesce(finite, F.lit(False)), "not finite").when(F.abs(norm(v) - 1) > tolerance, "not unit")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
