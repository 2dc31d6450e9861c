"""Vector arithmetic on array<double> columns, by built-in higher-order functions. Null vectors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x * x))


def scale(v: Column | str, by: Column) -> Column:
    return F.transform(_c(v), lambda x: x * by)


def l2_normalized(v: Column | str) -> Column:
    """v over its length; a zero vector stays."""
    n = norm(v)
    return F.transform(_c(v), lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0)))


def cosine(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def unit_dot(a: Column | str, b: Column | str) -> Column:
    """Cosine of vectors that have length 1."""
    return dot(a, b)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def rounded(v: Column | str, digits: int = 6) -> Column:
    return F.transform(_c(v), lambda x: F.round(x, digits))
