"""Walk-forward tests: windows of whole years, the best cell of each training window, its returns in the test window after it.

Everything is keyed by experiment, so many run at once. A window's sessions are met by equality on the session index; the
stitched curve of an experiment has a row a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward, asof_forward, range_join

C = F.col


def year_windows(sessions: DataFrame, by: list[str], train_years: int, test_years: int, embargo: int, anchored: bool = False) -> DataFrame:
    """(by, window, train_lo, train_hi, test_lo, test_hi) as session indices, from sessions (by, idx, d).

    The first training window starts on the first day; test windows follow each other and the last one is cut at the last
    day. The embargo's sessions before a test window are left out of its training. A window without a training or a test
    session has nulls there and gets no cell.
    """
    span = sessions.groupBy(*by).agg(F.min("d").alias("start"), F.max("d").alias("end"))
    years = lambda n: F.add_months("start", (n * 12).cast("int"))
    steps = F.floor(F.months_between("end", F.add_months("start", 12 * train_years)) / (12 * test_years)).cast("int")
    w = span.withColumn("window", F.explode(F.when(steps >= 0, F.sequence(F.lit(0), steps + 1)).otherwise(F.array().cast("array<int>"))))
    w = w.withColumn("test_start", years(C("window") * test_years + train_years)).where("test_start <= end")
    w = w.withColumn("test_end", F.least(F.date_sub(years((C("window") + 1) * test_years + train_years), 1), "end"))
    w = w.withColumn("train_start", C("start") if anchored else years(C("window") * test_years))
    at = sessions.select(*by, "d", "idx")

    def place(rows: DataFrame, day: str, name: str, how, **more) -> DataFrame:
        keep = [c for c in rows.columns if c != day]
        return how(rows.withColumnRenamed(day, "d"), at, by, "d", ["idx"], **more).select(*keep, C("d").alias(day), C("idx").alias(name))

    w = place(w, "train_start", "train_lo", asof_forward)
    w = place(w, "test_start", "before", asof_backward, strict=True)
    w = place(w, "test_start", "test_lo", asof_forward)
    w = place(w, "test_end", "test_hi", asof_backward)
    w = w.withColumn("train_hi", C("before") - embargo)
    trains, tests = C("train_lo") <= C("train_hi"), C("test_lo") <= C("test_hi")
    return w.select(*by, "window", *[F.when(trains, C(c)).alias(c) for c in ("train_lo", "train_hi")], *[F.when(tests, C(c)).alias(c) for c in ("test_lo", "test_hi")])


def train_scores(returns: DataFrame, windows: DataFrame, by: list[str], axes: list[str], ret: str = "ret") -> DataFrame:
    """(by, window, axes, score): each cell's mean over deviation of a session's return in the window's training sessions.

    returns has (by, axes, idx, ret). Cells with fewer than two returns or without any variation have no score.
    """
    j = range_join(returns, windows.select(*by, "window", "train_lo", "train_hi"), by, "idx", "train_lo", "train_hi")
    g = j.groupBy(*by, "window", *axes).agg(F.try_divide(F.avg(ret), F.stddev_samp(ret)).alias("score"))
    return g.where(C("score").isNotNull() & ~F.isnan("score"))


def neighbor_scores(scores: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """scores with value: the mean score of the cells one step away on any axes, a cell's own score if it has none.

    Axes are whole numbers. Each cell sends its score to its neighbours' places.
    """
    sent = scores.select(*keys, *axes, C("score").alias("__s"))
    for a in axes:
        sent = sent.withColumn(f"__{a}", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    moved = F.lit(False)
    for a in axes:
        moved = moved | (C(f"__{a}") != 0)
    sent = sent.where(moved).select(*keys, *[(C(a) + C(f"__{a}")).cast(dict(scores.dtypes)[a]).alias(a) for a in axes], "__s")
    mean = sent.groupBy(*keys, *axes).agg(F.avg("__s").alias("__m"))
    return scores.join(mean, [*keys, *axes], "left").withColumn("value", F.coalesce("__m", "score")).drop("__m")


def pick_cells(scores: DataFrame, windows: DataFrame, by: list[str], axes: list[str], rule: str = "neighbor_mean") -> DataFrame:
    """windows with the axes, score and value of the cell picked in each: the highest value, of equal ones the first in order.

    rule is neighbor_mean or train_sharpe_max. A window without a score keeps nulls.
    """
    keys = [*by, "window"]
    valued = neighbor_scores(scores, keys, axes) if rule == "neighbor_mean" else scores.withColumn("value", C("score"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), *axes))
    top = valued.withColumn("__r", best).where("__r = 1").select(*keys, *axes, "score", "value")
    return windows.join(top, keys, "left")


def stitch(returns: DataFrame, picks: DataFrame, by: list[str], axes: list[str], ret: str = "ret") -> DataFrame:
    """(by, window, idx, ret, equity): the picked cells' returns of the test windows, one behind the other.

    The first row of an experiment is its base of 1; a window's first session has no return, as each test is a run of its
    own that starts there.
    """
    spans = picks.where(C("score").isNotNull() & C("test_lo").isNotNull()).select(*by, *axes, "window", "test_lo", "test_hi")
    j = range_join(returns, spans, [*by, *axes], "idx", "test_lo", "test_hi").select(*by, "window", "idx", ret)
    first = F.min("idx").over(Window.partitionBy(*by, "window")) == C("idx")
    opens = F.min("idx").over(Window.partitionBy(*by)) == C("idx")
    j = j.withColumn("__first", first).withColumn("__opens", opens).where(~C("__first") | C("__opens"))
    j = j.withColumn(ret, F.when(~C("__opens"), C(ret)))
    so_far = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*by, "window", "idx", ret, F.product(1 + F.coalesce(C(ret), F.lit(0.0))).over(so_far).alias("equity"))


def retention(curve: DataFrame, picks: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """(by, windows, out_of_sample, train_mean, retention, gap): what of the training score is left out of sample.

    gap says why there is no retention: no_cell (a window without one), out_of_sample_unavailable, non_positive_train.
    """
    p = picks.groupBy(*by).agg(F.count("*").alias("windows"), F.avg("score").alias("train_mean"), F.count_if(C("score").isNull()).alias("__none"))
    o = curve.groupBy(*by).agg(F.try_divide(F.avg(ret), F.stddev_samp(ret)).alias("__o"))
    j = p.join(o, by, "left").withColumn("out_of_sample", F.when((C("__none") == 0) & ~F.isnan("__o"), C("__o")))
    gap = F.when(C("__none") > 0, "no_cell").when(C("out_of_sample").isNull(), "out_of_sample_unavailable").when(C("train_mean") <= 0, "non_positive_train")
    j = j.withColumn("gap", gap)
    return j.select(*by, "windows", "out_of_sample", "train_mean", F.when(C("gap").isNull(), C("out_of_sample") / C("train_mean")).alias("retention"), "gap")
