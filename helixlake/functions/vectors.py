"""Column functions on arrays of numbers; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def cosine(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """Cosine; 0 where a length is not above ``least``."""
    return F.when((norm(a) > least) & (norm(b) > least), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def unit(v: Column | str) -> Column:
    """Length one: divided by the norm plus 1e-10."""
    size = norm(v) + F.lit(1e-10)
    return F.transform(_c(v), lambda x: x.cast("double") / size)
