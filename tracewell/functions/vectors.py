"""Sums of vector columns by key, one row a vector all the way."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def width(df: DataFrame, column: str) -> int:
    """Length of the column's vectors, read off one row; 0 if there is none."""
    found = df.filter(F.col(column).isNotNull()).select(F.size(column)).head(1)
    return found[0][0] if found else 0


def combined(df: DataFrame, keys: list[str], column: str, size: int, how: str = "sum", weight: str | None = None) -> DataFrame:
    """(keys, column): sum or mean of a key's vectors, each times its row's weight if one is named.

    One aggregate an element, so that tasks add up what they hold before the shuffle and no row is a single element.
    """
    one = {"sum": F.sum, "mean": F.avg}[how]
    times = F.lit(1.0) if weight is None else F.col(weight)
    parts = [one(F.col(column)[i].cast("double") * times).alias(f"_{i}") for i in range(size)]
    if not parts:
        return df.select(*keys).distinct().withColumn(column, F.array().cast("array<double>"))
    return df.groupBy(*keys).agg(*parts).select(*keys, F.array(*[f"_{i}" for i in range(size)]).alias(column))


def times_matrix(v: str | Column, matrix: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """A vector column times a matrix (inputs by outputs) plus a bias, batch by batch in numpy; null stays null."""
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        there = s.notna()
        if there.any():
            x = np.stack(s[there].to_numpy()).astype(float) @ matrix + (0 if bias is None else bias)
            out[there] = pd.Series(list(x), index=s.index[there])
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf("array<double>")(run)(v)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)
