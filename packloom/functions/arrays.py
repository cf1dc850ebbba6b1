"""Arrays to rows, and values used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each_element(
    df: DataFrame, array: Column | str, *keep: Column | str, position: str = "pos", value: str = "value"
) -> DataFrame:
    """``keep`` columns, and one row per element with its 0-based position.

    The outer form, because for a plain explode the optimizer adds a filter on the array's size
    further down, where a computed array is worked out once more.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    return rows.where(F.col(position).isNotNull())


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.transform(F.array(value), body)[0]
