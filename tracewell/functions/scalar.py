"""Scalar functions on labels, times, paths and numbers, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .integers import floor_div

EASTERN = "America/New_York"


def label(parts: list[Column], hashed: bool = False) -> Column:
    """Attributes joined by blanks; a missing one prints as None."""
    joined = F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.sha2(joined, 256) if hashed else joined


def ns_to_text(ns: Column, zone: str = EASTERN) -> Column:
    """`YYYY-MM-DD HH:MM:SS.nnnnnnnnn` in the zone."""
    seconds = floor_div(ns, 1_000_000_000)
    whole = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "yyyy-MM-dd HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"))


def text_to_ns(text: Column, zone: str = EASTERN) -> Column:
    """Wall-clock time, with up to nine decimals of a second or none, to nanoseconds."""
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    seconds = F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(whole, "yyyy-MM-dd HH:mm:ss"), zone))
    return seconds * F.lit(1_000_000_000) + F.rpad(part, 9, "0").cast("long")


def iso_to_ns(text: Column) -> Column:
    """ISO time with offset and optional milliseconds to nanoseconds."""
    return F.unix_millis(F.to_timestamp(text)) * F.lit(1_000_000)


def path_tokens(path: Column) -> Column:
    """Words of a path, slashes apart."""
    return _tokens(F.regexp_replace(F.regexp_replace(path, r"\\+", "/"), "/", " / "))


def address_tokens(address: Column) -> Column:
    return _tokens(F.regexp_replace(address, "([:.])", " $1 "))


def any_tokens(text: Column) -> Column:
    return _tokens(F.regexp_replace(F.regexp_replace(text, r"\\+", "/"), "([/:.])", " $1 "))


def label_tokens(text: Column, node_type: Column) -> Column:
    """Tokens by node type; an empty label gives one empty token."""
    return F.when(node_type == "netflow", address_tokens(text)).otherwise(path_tokens(text))


def _tokens(padded: Column) -> Column:
    return F.split(F.trim(padded), r"\s+")


def prefixes(path: Column, separator: str = "/") -> Column:
    """a/b/c to [a, a/b, a/b/c]."""
    parts = F.split(path, F.lit("\\Q" + separator + "\\E"))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))


def has_keyword(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def word_weights(n: Column, percent: float = 30.0) -> Column:
    """n weights in arithmetic sequence that sum to 1; each step falls by percent of the mean weight over n - 1 ... n."""
    d = -1 / n * F.lit(percent / 100.0)
    first = 1 / n - (n - 1) / 2 * d
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: first + i * d)


def positional(position: Column, size: int) -> Column:
    """Sinusoidal encoding of a position."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i % 2 == 0, F.sin(position / F.pow(F.lit(10000.0), i / size))).otherwise(F.cos(position / F.pow(F.lit(10000.0), (i - 1) / size))))


def l2_normal(v: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + eps
    return F.transform(v, lambda x: x / norm)


def min_max(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Value scaled to 0..1 within its group; constant groups give 0. Bounds are joined, so no group needs one task."""
    bounds = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return df.join(bounds, by).withColumn(out, scaled).drop("_lo", "_hi")


def least_greater(sorted_values: Column, x: Column) -> Column:
    return F.array_min(F.filter(sorted_values, lambda v: v > x))


def greatest_smaller(sorted_values: Column, x: Column) -> Column:
    return F.array_max(F.filter(sorted_values, lambda v: v < x))


def statistics(value: str) -> list[Column]:
    """Mean, population deviation and variance, and 90th percentile (linear)."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"), F.percentile(value, F.lit(0.9)).alias("p90")]


def class_weights(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, weight): n / (k * n_c), 0 for classes that do not occur."""
    n = labels.groupBy("class").agg(F.count("*").alias("n_c"))
    total = labels.agg(F.count("*").alias("n"))
    k = classes.agg(F.count("*").alias("k"))
    found = classes.join(n, "class", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(k))
    return found.select("class", F.coalesce(F.col("n") / (F.col("k") * F.col("n_c")), F.lit(0.0)).alias("weight"))


def near_equal_parts(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("part", F.ntile(n).over(W.partitionBy(*by).orderBy(*order)) - 1)


def mean_of_text(df: DataFrame, column: str = "value") -> DataFrame:
    """Mean of numbers in text rows, 1e-9 if there is none."""
    return df.agg(F.coalesce(F.avg(F.expr(f"try_cast({column} as double)")), F.lit(1e-9)).alias("mean"))


def display_label(path: Column, cmd: Column) -> Column:
    return F.regexp_replace(F.concat_ws("-", F.coalesce(path, F.lit("None")), F.coalesce(cmd, F.lit("None"))), "^None-", "")
