"""Vector expressions that stay in the JVM; arithmetic is in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is zero."""
    a, b = doubles(a), doubles(b)
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n))


def vector_literal(v) -> Column:
    """A driver-side vector as an array literal."""
    return F.array(*[F.lit(float(x)) for x in np.asarray(v, dtype=float).ravel()])


def mlp_score(x: Column, w0: Column, b0: Column, w2: Column, b2: Column) -> Column:
    """Score of a two-layer network (linear, rectifier, linear, sigmoid) whose weights are columns."""
    x = doubles(x)
    hidden = F.zip_with(w0, b0, lambda row, b: F.greatest(dot(row, x) + b, F.lit(0.0)))
    return 1 / (1 + F.exp(-(dot(hidden, w2) + b2)))


def mean_vector(positions: int, value: Column) -> Column:
    """Aggregate: the mean of equally long vectors, by position."""
    return F.array(*[F.avg(F.get(value, F.lit(i))) for i in range(positions)])
