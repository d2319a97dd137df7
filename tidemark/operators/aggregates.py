"""Aggregates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agg_filtered(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Counts and sums over the rows where a condition holds. specs: name -> (column to sum or *, condition)."""
    one = lambda c, on: F.count_if(on) if c == "*" else F.sum(F.when(on, F.col(c)))
    return df.groupBy(*keys).agg(*[one(c, on).alias(name) for name, (c, on) in specs.items()])


def any_flags(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])


def ordered_sum(df: DataFrame, keys: list[str], order: str, c: str) -> DataFrame:
    """The sum folded left to right in the order of a key. A group's cells meet in one row, so groups must be small."""
    cells = F.array_sort(F.collect_list(F.struct(order, c)))
    return df.groupBy(*keys).agg(cells.alias("cells")).select(*keys, F.aggregate("cells", F.lit(0.0), lambda a, x: a + x[c]).alias("total"))


def percentile_nearest(df: DataFrame, keys: list[str], c: str, q: float) -> DataFrame:
    """The value at place ceil(q n)."""
    d = df.where(F.col(c).isNotNull())
    w = Window.partitionBy(*keys)
    d = d.select(*keys, c, F.row_number().over(w.orderBy(c)).alias("r"), F.count("*").over(w).alias("n"))
    return d.where(F.col("r") == F.greatest(F.lit(1), F.ceil(F.col("n") * q))).select(*keys, F.col(c).alias("value"))


def moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd_pop"), F.stddev_samp(x).alias("sd"), F.var_samp(x).alias("variance"),
        F.covar_samp(x, y).alias("covariance"), F.regr_slope(x, y).alias("slope"),
    )


def higher_moments(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Skewness and kurtosis (3 for a normal distribution) of the population."""
    return df.groupBy(*keys).agg(F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def weighted_mean(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(w).isNotNull()
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.when(both, F.col(x) * F.col(w))), F.sum(F.when(both, F.col(w)))).alias("wmean"))


def weighted_available(weights: dict[str, float]) -> Column:
    """Weighted mean of the columns that are there, with their weights made to sum to one; null if none is."""
    names = sorted(weights)
    top = sum((F.when(F.col(c).isNotNull(), F.col(c) * weights[c]).otherwise(0.0) for c in names), F.lit(0.0))
    low = sum((F.when(F.col(c).isNotNull(), F.lit(weights[c])).otherwise(0.0) for c in names), F.lit(0.0))
    return F.when(low > 0, top / low)


def bucket_sums(df: DataFrame, keys: list[str], date: str, c: str, bucket: str) -> DataFrame:
    """Sums by week (from Monday), month or year."""
    return df.groupBy(*keys, F.date_trunc(bucket, F.col(date)).cast("date").alias("bucket")).agg(F.sum(c).alias("total"))
