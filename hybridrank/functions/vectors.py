"""Vector arithmetic on ``array<float|double>`` columns, evaluated in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy of ``v``; a zero vector is returned unchanged."""
    vec = as_double(v)
    n = F.sqrt(squared_norm(vec))
    return F.when(n > 0, F.transform(vec, lambda x: x / n)).otherwise(vec)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equal-length vectors."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
