"""Joins in which one key may hold a share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # a key with more than one in so many rows is joined in every task


def join_hot(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table of one row a key at most.

    Keys that hold more than one in HOT of the rows, fewer than HOT of them, go to every task; the others go
    through the shuffle. Both sides are parted by the hot keys' hashes.
    """
    counts = rows.groupBy(F.xxhash64(*keys).alias("_h")).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    if not total or most * HOT <= total:
        return rows.join(one, keys)
    hot = [r[0] for r in counts.filter(F.col("count") * HOT > total).select("_h").collect()]  # fewer than HOT numbers
    apart = F.xxhash64(*keys).isin(hot)
    return rows.filter(apart).join(F.broadcast(one.filter(apart)), keys).unionByName(rows.filter(~apart).join(one.filter(~apart), keys))
