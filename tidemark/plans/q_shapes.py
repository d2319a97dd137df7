"""Chart shapes and channels over suppliers' daily prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fans, shapes, signals, technical

from . import views
from .registry import query

C = F.col


def days(spark, sf):
    """(sid, n, d, open, high, low, close, volume): days of suppliers' line prices, n the number of the day in its supplier.

    Lines are brought together by supplier at once, so days, their numbers and all that follows in a supplier's order of days
    need one shuffle and one sort.
    """
    li = views.read(spark, sf, "lineitem").where("l_quantity > 0").withColumn("p", C("l_extendedprice") / C("l_quantity") / 100)
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    li = li.select(C("l_suppkey").alias("sid"), C("l_shipdate").cast("date").alias("d"), at.alias("at"), "p", "l_quantity").repartition("sid")
    b = li.groupBy("sid", "d").agg(
        F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("l_quantity").alias("volume"),
    )
    return b.withColumn("n", (F.row_number().over(Window.partitionBy("sid").orderBy("d")) - 1).cast("long"))


def numbered_bars(spark, sf):
    """(sid, n, d, open, high, low, close, atr): days with their average range."""
    return technical.with_average_range(days(spark, sf).select("sid", "n", "d", "open", "high", "low", "close"), "sid", "d")


def marked_bars(spark, sf):
    """numbered_bars with the swings on their bars, both of one group a security; and the swings."""
    m = technical.with_swings(days(spark, sf).select("sid", "n", "d", "open", "high", "low", "close"), "sid", "d", "n", 14, 2.0)
    return m, m.where("kind IS NOT NULL").select("sid", "n", "kind", "price", "confirmed")


def swings(bars):
    return technical.zigzag(bars.select("sid", "n", "high", "low", "close"), "sid", "n", 14, 2.0)


@query("t12_swing_shapes", None)
def t12_swings(spark, sf):
    b = numbered_bars(spark, sf)
    return shapes.swing_shapes(swings(b), b, "sid", "n")


@query("t12_flags", None)
def t12_flags(spark, sf):
    return shapes.flags(numbered_bars(spark, sf), "sid", "n")


@query("t12_candle_shapes", None)
def t12_candles(spark, sf):
    return shapes.candle_shapes(numbered_bars(spark, sf), "sid", "n")


@query("t15_trend_channels", None)
def t15_channels(spark, sf):
    b, pivots = marked_bars(spark, sf)
    return shapes.trend_channels(pivots, b, "sid", "n", 3)


# ---- signals, zones, regimes

PERIODS = signals.Periods(short=8, middle=15, long=30, strength=7, fast=5, slow=10, signal=4, cloud=(4, 8, 16), stochastic=(6, 3, 3), profile=25, bins=12)


def measured(spark, sf, before=False):
    return signals.measured(days(spark, sf).drop("d"), "sid", "n", PERIODS, (14, 2.0), before)


@query("t11_signals", None)
def t11_signals(spark, sf):
    return signals.events(measured(spark, sf, before=True), "sid", "n")


@query("t11_states", None)
def t11_states(spark, sf):
    return signals.states(measured(spark, sf), "sid", "n")


@query("t14_tested_zones", None)
def t14_zones(spark, sf):
    b = numbered_bars(spark, sf).where("atr IS NOT NULL")
    return signals.tested_zones(swings(b.drop("atr")).select("sid", "n", "price", "confirmed"), b, "sid", "n", 0.2)


@query("t10_major_swings", None)
def t10_major(spark, sf):
    b = numbered_bars(spark, sf)
    return signals.significant(swings(b), b, "sid", "n", 10)


@query("t16_regimes", None)
def t16_regimes(spark, sf):
    b, pivots = marked_bars(spark, sf)
    return signals.regimes(b, signals.significant(pivots, b, "sid", "n", 5), "sid", "n", 120)


@query("t18_fan_scores", None)
def t18_fans(spark, sf):
    b = numbered_bars(spark, sf)
    major = signals.significant(swings(b), b, "sid", "n", 3).where("major").select("sid", "n", "kind", "price")
    return fans.fan_scores(major, b, "sid", "n", fans.Rules(least_gap=20, least_bars=30, recent=6))
