"""Ranks and scores of a column among its peers, the rows with the same keys. Nulls are no peers and stay null."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _peers(keys: list, c: Column):
    return Window.partitionBy(*keys, c.isNull())


def _only(c: Column, x: Column) -> Column:
    return F.when(c.isNotNull(), x)


def average_rank(keys: list, c: Column) -> Column:
    """1-based rank, ties share the mean of their places."""
    w = _peers(keys, c)
    ties = F.count("*").over(Window.partitionBy(*keys, c))
    return _only(c, F.rank().over(w.orderBy(c)) + (ties - 1) / 2)


def rank_avg(keys: list, c: Column) -> Column:
    """Average rank from 0 to 1; a lone peer has 0."""
    n = F.count("*").over(_peers(keys, c))
    return _only(c, (average_rank(keys, c) - 1) / F.greatest(n - 1, F.lit(1)))


def pct_rank_100(keys: list, c: Column) -> Column:
    """Average rank from 0 to 100; a lone peer has 50."""
    n = F.count("*").over(_peers(keys, c))
    return _only(c, F.when(n == 1, F.lit(50.0)).otherwise((average_rank(keys, c) - 1) * 100 / (n - 1)))


def pct_rank_min(keys: list, c: Column) -> Column:
    """SQL's percent_rank: ties share the least place."""
    return _only(c, F.percent_rank().over(_peers(keys, c).orderBy(c)))


def percentrank_inc(keys: list, c: Column) -> Column:
    """Share of the other peers below; NaN is no peer."""
    x = F.when(~F.isnan(c), c)
    n = F.count("*").over(_peers(keys, x))
    return _only(x, F.try_divide(F.rank().over(_peers(keys, x).orderBy(x)) - 1, n - 1))


def zscore_pop(keys: list, c: Column) -> Column:
    """Distance from the mean in population standard deviations; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(c).over(w)
    return _only(c, F.when(sd == 0, F.lit(0.0)).otherwise((c - F.avg(c).over(w)) / sd))


def zscore_winsor(keys: list, c: Column, limit: float = 3.0) -> Column:
    """z by the sample deviation, clipped at limit; 0 for fewer than two peers or no spread."""
    w = Window.partitionBy(*keys)
    sd, n = F.stddev_samp(c).over(w), F.count(c).over(w)
    z = (c - F.avg(c).over(w)) / sd
    return _only(c, F.when((n < 2) | (sd == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), z))))


def winsorize(keys: list, c: Column, lo: float, hi: float) -> Column:
    """Clipped at quantiles that are interpolated linearly at (n - 1) q."""
    w = Window.partitionBy(*keys)
    return _only(c, F.greatest(F.percentile(c, lo).over(w), F.least(F.percentile(c, hi).over(w), c)))


def demean(keys: list, c: Column) -> Column:
    return c - F.avg(c).over(Window.partitionBy(*keys))


def group_rank(keys: list, group: str, c: Column, min_size: int) -> Column:
    """pct_rank_100 inside a group; groups with fewer peers than min_size are ranked among all."""
    size = F.count(c).over(Window.partitionBy(*keys, group))
    return _only(c, F.when((size >= min_size) & F.col(group).isNotNull(), pct_rank_100([*keys, group], c)).otherwise(pct_rank_100(keys, c)))
