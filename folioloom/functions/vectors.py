"""Column expressions over vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is found once, however often f's own functions of elements name it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 if either is empty; a zero norm counts as 1."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.when(F.size(a) == n, a).otherwise(F.slice(a, 1, n)), F.when(F.size(b) == n, b).otherwise(F.slice(b, 1, n))
    of = lambda v: F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.when(n > 0, dot(x, y) / (of(x) * of(y))).otherwise(0.0)
