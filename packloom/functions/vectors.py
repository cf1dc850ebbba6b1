"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from packloom.functions.arrays import bind

# Fixed value: lower bound of the squared norm.
NORM_EPSILON = 1e-8


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def finite(vector: Column | str) -> Column:
    """NaN and infinities become 0."""
    infinity = F.lit(math.inf)
    return F.transform(
        _col(vector),
        lambda x: F.when(F.isnan(x) | (F.abs(x.cast("double")) == infinity), F.lit(0.0)).otherwise(
            x.cast("double")
        ),
    )


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.greatest(dot(vector, vector), F.lit(NORM_EPSILON)))
    return F.zip_with(vector, F.array_repeat(norm, F.size(vector)), lambda x, n: x / n)


def normalize(vector: Column | str, present: Column | str | None = None) -> Column:
    """Scale to unit length, safe for zero vectors; vectors that are not ``present`` become zero."""
    unit = bind(finite(vector), _unit)
    if present is None:
        return unit
    return F.when(_col(present), unit).otherwise(zeros(F.size(_col(vector))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def zeros(size: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), size)
