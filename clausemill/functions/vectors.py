"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for unequal lengths, empty or zero vectors and nulls."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.coalesce(F.when(usable, dot(a, b) / size), F.lit(0.0))
