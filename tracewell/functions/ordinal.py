"""Row numbers and running values without one task per group.

Groups are cut into slices of the first order column, a long; inside a slice a
window runs, and each slice gets what all before it come to, taken over one row a
slice. No task sees more than a slice of a group, or one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .integers import floor_div
from .tables import stored

HOUR = 3_600_000_000_000
SLICE = 200_000  # rows of a slice that `sliced` aims at
_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def with_running(df: DataFrame, group: list[str], order: list[str], width: int, values: dict[str, tuple[str, str | Column]], before: bool = False) -> DataFrame:
    """Adds name: kind (sum, max, min) of a value over the rows of the group up to each row by order; null if there is none.

    values maps a name to (kind, column); with before, the row itself does not count.
    """
    d = df.withColumn("_slice", floor_div(F.col(order[0]), width))
    for n, (_, v) in values.items():
        d = d.withColumn(f"_v_{n}", F.col(v) if isinstance(v, str) else v)
    totals = d.groupBy(*group, "_slice").agg(*[_KINDS[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    above = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*group, "_slice", *[_KINDS[k](f"_t_{n}").over(above).alias(f"_s_{n}") for n, (k, _) in values.items()])
    own = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    local = d.select("*", *[_KINDS[k](f"_v_{n}").over(own).alias(f"_l_{n}") for n, (k, _) in values.items()])
    joined = local.join(starts, [*group, "_slice"])

    def both(n: str, kind: str) -> Column:
        s, x = F.col(f"_s_{n}"), F.col(f"_l_{n}")
        if kind == "sum":
            return F.coalesce(s + x, s, x)
        return (F.greatest if kind == "max" else F.least)(s, x)  # nulls do not count

    return joined.select(*[c for c in df.columns if c not in values], *[both(n, k).alias(n) for n, (k, _) in values.items()])


def with_ordinal(df: DataFrame, group: list[str], order: list[str], width: int, name: str = "ordinal") -> DataFrame:
    """Zero-based place of each row in its group by order; order[0] is a long."""
    counted = with_running(df, group, order, width, {name: ("sum", F.lit(1).cast("long"))})
    return counted.withColumn(name, F.col(name) - 1)


def with_previous(df: DataFrame, group: list[str], order: list[str], width: int, column: str, name: str) -> DataFrame:
    """Adds the column's value in the group's row before, null in the first."""
    d = df.withColumn("_slice", floor_div(F.col(order[0]), width))
    last = d.groupBy(*group, "_slice").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(W.partitionBy(*group).orderBy("_slice"))).drop("_last")
    inside = F.lag(F.struct(F.col(column).alias("v"))).over(W.partitionBy(*group, "_slice").orderBy(*order))
    return d.withColumn("_inside", inside).join(carried, [*group, "_slice"]).withColumn(name, F.coalesce("_inside", "_carried")["v"]).drop("_inside", "_carried", "_slice")


def sliced(df: DataFrame, order: list[str | Column], slices: int | None = None) -> DataFrame:
    """df with _slice: ranges of rows in order, numbered in that order, of about SLICE rows each.

    Ranges come from Spark's own sampling of the sort key, so any distribution gives even slices as long as
    the key tells rows apart. The rows are stored, since every reader has to see the same cuts.
    """
    n = slices or max(16, -(-df.count() // SLICE))
    return stored(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()), "sliced")


def carried(sliced_rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """(_slice, _carried): the value in the last row of the slices before, one row a slice."""
    last = sliced_rows.groupBy("_slice").agg(F.max_by(F.struct(value.alias("v")), order).alias("_last"))
    return last.select("_slice", F.lag("_last").over(W.orderBy("_slice")).alias("_carried"))
