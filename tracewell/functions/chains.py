"""Places that a chain of pointers visits, without walking it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def reached(jumps: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at): all places on the ways from roots(keys, at) along jumps(keys, at, next), roots included.

    Each place has at most one jump, and a jump never returns to a place. Jumps are doubled until no root
    has one left, so there are as many rounds as the longest way's length has binary digits; then each
    table, from the longest jumps down, adds the places that lie one jump behind those found.
    """
    tables = [stored(jumps.filter("next is not null").select(*keys, "at", "next"), "jumps")]
    while roots.join(tables[-1], [*keys, "at"], "left_semi").head(1):
        far = tables[-1].select(*keys, F.col("at").alias("next"), F.col("next").alias("after"))
        tables.append(stored(tables[-1].join(far, [*keys, "next"]).select(*keys, "at", F.col("after").alias("next")), "jumps"))
    found = roots.select(*keys, "at")
    for table in reversed(tables[:-1]):
        found = found.join(table, [*keys, "at"], "left").select(*keys, F.explode(F.array_compact(F.array("at", "next"))).alias("at"))
    return found
