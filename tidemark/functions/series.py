"""Statistics of a security's own past. by names the security's columns, order the session's."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def _rows(by, order, window: int, lag: int = 0):
    return _w(by, order).rowsBetween(-(lag + window - 1), -lag)


def full(by, order, c: Column, window: int, lag: int, x: Column) -> Column:
    """x, but null unless all cells of the window are there."""
    return F.when(F.count(c).over(_rows(by, order, window, lag)) == window, x)


def lag_sessions(by, order, c: Column, k: int) -> Column:
    return F.lag(c, k).over(_w(by, order))


def ts_mean(by, order, c, window, lag=0) -> Column:
    return full(by, order, c, window, lag, F.avg(c).over(_rows(by, order, window, lag)))


def ts_std(by, order, c, window, lag=0) -> Column:
    return full(by, order, c, window, lag, F.stddev_pop(c).over(_rows(by, order, window, lag)))


def ts_min(by, order, c, window, lag=0) -> Column:
    return full(by, order, c, window, lag, F.min(c).over(_rows(by, order, window, lag)))


def ts_max(by, order, c, window, lag=0) -> Column:
    return full(by, order, c, window, lag, F.max(c).over(_rows(by, order, window, lag)))


def ts_delta(by, order, c, window, lag=0) -> Column:
    """Last minus first of the window."""
    return full(by, order, c, window, lag, F.lag(c, lag).over(_w(by, order)) - F.lag(c, lag + window - 1).over(_w(by, order)))


def ts_momentum(by, order, c, window, lag=0) -> Column:
    """Last over first of the window, less one; null where the first is 0."""
    first = F.lag(c, lag + window - 1).over(_w(by, order))
    return full(by, order, c, window, lag, F.try_divide(F.lag(c, lag).over(_w(by, order)), first) - 1)


def running(by, order):
    return _w(by, order).rowsBetween(Window.unboundedPreceding, 0)


def following(by, order):
    return _w(by, order).rowsBetween(0, Window.unboundedFollowing)


def last_event_idx(by, order, flag: Column, idx: str) -> Column:
    """The index of the last row so far where flag holds."""
    return F.max(F.when(flag, F.col(idx))).over(running(by, order))


def high_low_range(by, idx: str, hi: Column, lo: Column, n: int) -> tuple[Column, Column]:
    """Highest and lowest of the last n sessions by index, gaps included."""
    w = Window.partitionBy(*by).orderBy(idx).rangeBetween(-(n - 1), 0)
    return F.max(hi).over(w), F.min(lo).over(w)


def cumprod(by, order, c: Column) -> Column:
    return F.product(c).over(running(by, order))


def revprod(by, order, c: Column) -> Column:
    return F.product(c).over(following(by, order))


def trailing_pct(by, order, c: Column, n: int, min_n: int) -> Column:
    """Share of the last n values below the newest, ties counting half; null with fewer than min_n values."""
    cells = F.collect_list(c).over(_rows(by, order, n))
    below = F.size(F.filter(cells, lambda x: x < c))
    equal = F.size(F.filter(cells, lambda x: x == c))
    return F.when(F.size(cells) >= min_n, (below + (equal - 1) * 0.5) / F.greatest(F.size(cells) - 1, F.lit(1)))
