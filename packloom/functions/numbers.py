"""Whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column | str, by: int) -> Column:
    """Quotient rounded down, exact for any LONG; ``floor(a / b)`` would go through a double."""
    value = F.col(value) if isinstance(value, str) else value
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))
