"""Operators over ordered rows: islands, neighbours, streaks, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series


def islands(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Runs of consecutive seq: (by, span_seq, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(seq)
    runs = df.select(*by, seq).distinct().withColumn("run", F.col(seq) - F.row_number().over(w))
    spans = runs.groupBy(*by, "run").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n"))
    return spans.withColumn("span_seq", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).drop("run")


def merged_windows(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Overlapping or touching windows as one: (by, island, lo, hi)."""
    before = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy(*by).orderBy(lo, hi)
    new = F.when(F.col(lo) <= F.max(hi).over(before) + 1, 0).otherwise(1)
    d = df.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi))


def previous_session(df: DataFrame, by: list[str], idx: str, c: str) -> Column:
    """c of the session right before; null if that one is missing."""
    w = Window.partitionBy(*by).orderBy(idx)
    return F.when(F.lag(idx).over(w) == F.col(idx) - 1, F.lag(c).over(w))


def liquidity_rank(df: DataFrame, keys: list[str], c: str, member: Column) -> DataFrame:
    """cume_dist inside the population where member holds; null outside."""
    d = df.withColumn("__in", member)
    w = Window.partitionBy(*keys, "__in").orderBy(F.col(c).asc_nulls_last())
    return d.withColumn("liquidity_rank", F.when(F.col("__in"), F.cume_dist().over(w))).drop("__in")


def top_n_capped(df: DataFrame, keys: list[str], group: str, order: list[Column], n: int, per: int) -> DataFrame:
    """The first n in order of which each group has per at most."""
    inside = F.row_number().over(Window.partitionBy(*keys, group).orderBy(*order))
    d = df.withColumn("__in", inside).where(F.col("__in") <= per)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return d.where(F.col("rank") <= n).drop("__in")


def final_rank(df: DataFrame, keys: list[str], score: str, id_: str, excluded: Column) -> DataFrame:
    """Rank by falling score, then id; excluded rows keep their score and have no rank."""
    w = Window.partitionBy(*keys, excluded).orderBy(F.col(score).desc_nulls_last(), id_)
    return df.withColumn("rank", F.when(~excluded, F.row_number().over(w)))


def forward_rank(df: DataFrame, by: list[str], period: str, forward: Column) -> DataFrame:
    """dense_rank of the forward periods; null for the others."""
    w = Window.partitionBy(*by, forward).orderBy(period)
    return df.withColumn("fy_rank", F.when(forward, F.dense_rank().over(w)))


def coverage_streak(df: DataFrame, by: list[str], order: str, covered: Column) -> DataFrame:
    """Length of the covered run up to each row, with the first and last covered row so far."""
    w = series.running(by, order)
    d = df.withColumn("__c", covered).withColumn("__gap", F.sum(F.when(F.col("__c"), 0).otherwise(1)).over(w))
    run = Window.partitionBy(*by, "__gap").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.select(
        *df.columns,
        F.when(F.col("__c"), F.sum(F.col("__c").cast("int")).over(run)).otherwise(0).alias("streak"),
        F.min(F.when(F.col("__c"), F.col(order))).over(w).alias("first_covered"),
        F.max(F.when(F.col("__c"), F.col(order))).over(w).alias("last_covered"),
    )


def period_frontier(df: DataFrame, by: list[str], available: str, period: str) -> DataFrame:
    """Whether a row holds the newest period that had been published by its date."""
    w = Window.partitionBy(*by).orderBy(available).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("frontier", F.col(period) == F.max(period).over(w))
