"""Exact integer arithmetic on nanosecond times, which a double cannot hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, n: int) -> Column:
    """Greatest integer not above a / n, for n > 0."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))
