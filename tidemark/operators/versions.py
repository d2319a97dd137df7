"""Which of several versions of a row holds. Orders are total and put nulls last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(order: list) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c).asc_nulls_last() for c in order]


def first_version(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key, with the number of rows it had."""
    w = Window.partitionBy(*key)
    d = df.withColumn("__r", F.row_number().over(w.orderBy(*_last(order)))).withColumn("n_src_rows", F.count("*").over(w))
    return d.where("__r = 1").drop("__r")


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    d = df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])))
    return d.where("__r = 1").drop("__r")


def dedupe_payload(df: DataFrame, key: list[str], payload: list[str], order: list) -> DataFrame:
    """One row of each key and payload, the first observed, with how often it was observed."""
    return first_version(df, [*key, *payload], order).withColumnRenamed("n_src_rows", "n_observed")


def fold_same_day(df: DataFrame, key: list[str], day: str, order: list[str]) -> DataFrame:
    """The last observation of each key and day."""
    return latest_per_key(df, [*key, day], order)


def fold_consecutive(df: DataFrame, unit: list[str], order: list[str], payload: str) -> DataFrame:
    """Without versions equal to the one just before: of A, B, A all three stay."""
    w = Window.partitionBy(*unit).orderBy(*_last(order))
    d = df.withColumn("__n", F.row_number().over(w)).withColumn("__p", F.lag(payload).over(w))
    return d.where((F.col("__n") == 1) | ~F.col(payload).eqNullSafe(F.col("__p"))).drop("__n", "__p")


def stale_keys(df: DataFrame, label: str, unit: str, day: str) -> DataFrame:
    """Units whose last day is before the newest day of their label."""
    last = df.groupBy(label, unit).agg(F.max(day).alias("last"))
    return last.withColumn("newest", F.max("last").over(Window.partitionBy(label))).where("last < newest")


def fold_with_rejects(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Every row with a reject_reason: null for the first version of its key, version_folded for the others."""
    w = Window.partitionBy(*key).orderBy(*_last(order))
    return df.withColumn("reject_reason", F.when(F.row_number().over(w) > 1, F.lit("version_folded")))


def pick_first_known(df: DataFrame, key: list[str], available: str, source: str) -> DataFrame:
    return first_version(df, key, [available, source]).drop("n_src_rows")


def pick_source(df: DataFrame, key: list[str], source: str, priority: list[str]) -> DataFrame:
    """The row of the first source in priority that has one; unlisted sources come last, by name."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(source)), F.lit(0))
    order = F.when(place == 0, len(priority) + 1).otherwise(place)
    return first_version(df, key, [order.asc(), source]).drop("n_src_rows")


def set_compare(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys with the sides they are on: left, right or both."""
    both = left.select(*key).distinct().withColumn("s", F.lit(1)).unionByName(right.select(*key).distinct().withColumn("s", F.lit(2)))
    side = F.sum("s")
    return both.groupBy(*key).agg(F.when(side == 1, "left").when(side == 2, "right").otherwise("both").alias("side"))


def jaccard_mean(a: DataFrame, b: DataFrame, period: str, name: str) -> DataFrame:
    """Mean over the periods of both tables of shared names over all names."""
    one = lambda d, s: d.groupBy(period).agg(F.collect_set(name).alias(s))
    j = one(a, "x").join(one(b, "y"), period)
    return j.agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"), F.count("*").alias("periods"))
