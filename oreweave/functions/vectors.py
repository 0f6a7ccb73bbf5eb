"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 for empty, mismatched or zero vectors."""
    lengths = norm(left) * norm(right)
    usable = (F.size(left) > 0) & (F.size(left) == F.size(right)) & (lengths > 0)
    return F.when(usable, dot(left, right) / lengths).otherwise(F.lit(0.0))


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a column against one query vector known when the plan is built."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    if not length:
        return F.lit(0.0)
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    own = norm(vector)
    return F.when((F.size(vector) == len(query)) & (own > 0), dot(vector, unit) / own).otherwise(F.lit(0.0))


def normalize(vector: Column) -> Column:
    length = norm(vector)
    scale = F.when(length > 0, length).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: x.cast("double") / scale)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
