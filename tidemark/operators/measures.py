"""Performance of accounts in full, regressions with Newey-West errors by group, grids of parameters from tables.

Everything is keyed: an account or a series is a group, and what depends on its order are windows over it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import scheduled

C = F.col
YEAR_DAYS = 365


def _column(x: Column | str) -> Column:
    return C(x) if isinstance(x, str) else x


def normal_cdf(x: Column | str) -> Column:
    """The normal distribution's probability below x, to about 1e-15: a series of the density's integral."""
    x = _column(x)
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x))
    start = F.struct(z.alias("t"), z.alias("s"))
    step = lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda a: a["s"])
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series)))


def normal_quantile(p: Column | str) -> Column:
    """The x below which the normal distribution has probability p, by halving; null outside (0, 1)."""
    p = _column(p)
    start = F.struct(F.lit(-8.0).alias("lo"), F.lit(8.0).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        below = normal_cdf(mid) < p
        return F.struct(F.when(below, mid).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(mid).alias("hi"))

    return F.when((p > 0) & (p < 1), F.aggregate(F.sequence(F.lit(1), F.lit(56)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2))


def metrics(points: DataFrame, trades: DataFrame, costs: DataFrame, rates: DataFrame, by: str, year: int = 252) -> DataFrame:
    """The 24 measures of each account, and a reason for each that may be missing: (by, measures, *_reason).

    points: (by, d, equity, benchmark, gross, net), equity above 0; trades: (by, pnl) of closed trades; costs: (by, notional,
    fees, taxes, slippage, carry); rates: (d, rate), a year's rate known from its day on. Excess returns are over the rate of
    the interval's first day by actual days over 365; an account with an interval before all rates has no ratio that needs
    them. Volatility is that of the raw returns; downside that of excess returns below 0 over all. Years under one are not
    annualised. Durations are in sessions. A column base in points marks the point before a window: returns start from it,
    averages leave it out.
    """
    w = Window.partitionBy(by).orderBy("d")
    based = F.coalesce("base", F.lit(False)) if "base" in points.columns else F.lit(False)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    p = points.select(by, "d", based.alias("base"), *[C(c).cast("double").alias(c) for c in ("equity", "benchmark", "gross", "net")])
    p = p.withColumn("was", F.lag("equity").over(w)).withColumn("from", F.lag("d").over(w)).withColumn("n", F.row_number().over(w)).withColumn("peak", F.max("equity").over(so_far))
    p = scheduled(p, "from", rates, ["rate"]).withColumn("ret", C("equity") / C("was") - 1)
    p = p.withColumn("excess", C("ret") - C("rate") * F.datediff("d", "from") / YEAR_DAYS).withColumn("depth", C("equity") / C("peak") - 1)
    p = p.withColumn("top", F.max(F.when(C("depth") == 0, C("n"))).over(so_far))
    worst = Window.partitionBy(by)
    # the deepest point, the first of equals, and the peak before it
    p = p.withColumn("low", F.min(F.struct("depth", "n", "peak")).over(worst))
    back = F.min(F.when((C("n") > C("low.n")) & (C("equity") >= C("low.peak")), C("n"))).over(worst)
    p = p.withColumn("back", F.when(C("low.depth") < 0, back - C("low.n")))
    g = p.groupBy(by).agg(
        F.count("ret").alias("k"), F.count("*").alias("points"), F.min_by("equity", "d").alias("first"), F.max_by("equity", "d").alias("last"), F.datediff(F.max("d"), F.min("d")).alias("days"),
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("g3"), (F.kurtosis("ret") + 3).alias("g4"), F.count("excess").alias("covered"), F.avg("excess").alias("ex"),
        F.sqrt(F.sum(F.when(C("excess") < 0, C("excess") * C("excess")).otherwise(0.0)) / F.count("ret")).alias("down"), F.min("depth").alias("max_drawdown"), F.max(C("n") - C("top")).alias("longest"), F.max("back").alias("recovery"),
        F.count("benchmark").alias("b"), F.min_by("benchmark", "d").alias("b0"), F.max_by("benchmark", "d").alias("b1"), F.avg(F.when(~C("base"), C("equity"))).alias("average"),
        *[f(F.when(~C("base"), C(c))).alias(f"{name}_{c}") for c in ("gross", "net") for name, f in (("average", F.avg), ("maximum", F.max))],
    )
    t = trades.groupBy(by).agg(F.count("*").alias("trades"), F.avg((C("pnl") > 0).cast("double")).alias("win"), F.sum(F.when(C("pnl") > 0, C("pnl")).otherwise(0.0)).alias("won"), F.sum(F.when(C("pnl") < 0, -C("pnl"))).alias("lost"))
    spent = ["notional", "fees", "taxes", "slippage", "carry"]
    c = costs.groupBy(by).agg(*[F.sum(x).alias(x) for x in spent])
    g = g.join(t, by, "left").join(c, by, "left").fillna(0, ["trades", *spent])
    covered = C("covered") == C("k")
    several = (C("k") > 1) & covered
    total, years = C("last") / C("first") - 1, C("days") / YEAR_DAYS
    g = g.withColumn("total_return", total).withColumn("cagr", F.when(years >= 1, F.pow(1 + total, 1 / years) - 1))
    g = g.withColumn("s", F.when(several & (C("sd") > 0), C("ex") / C("sd")))
    g = g.withColumn("se", F.sqrt(F.greatest(F.lit(0.0), (1 - C("g3") * C("s") + (C("g4") - 1) / 4 * C("s") * C("s")) / (C("k") - 1))))
    g = g.withColumn("benchmark_return", F.when((C("b") == C("points")) & (C("b0") != 0), C("b1") / C("b0") - 1))
    ratio_reason = F.when(~covered, "base_rate_not_covered")
    error_reason = F.when(C("s").isNull(), F.coalesce(ratio_reason, F.lit("zero_return_variance"))).when(C("se") == 0, "two_valued_returns")
    annual = math.sqrt(year)
    values = {
        "total_return": (total, None), "cagr": (C("cagr"), F.lit("period_under_one_year")), "volatility": (F.coalesce(C("sd") * annual, F.lit(0.0)), None),
        "sharpe": (C("s") * annual, F.coalesce(ratio_reason, F.lit("zero_return_variance"))), "sharpe_error": (F.when(C("se") > 0, C("se") * annual), error_reason),
        "probabilistic_sharpe": (F.when(C("se") > 0, normal_cdf(C("s") / C("se"))), error_reason), "sortino": (F.when(several & (C("down") > 0), C("ex") / C("down") * annual), F.coalesce(ratio_reason, F.lit("no_downside_variation"))),
        "max_drawdown": (C("max_drawdown"), None), "calmar": (F.when(C("max_drawdown") < 0, C("cagr") / -C("max_drawdown")), F.when(C("cagr").isNull(), "period_under_one_year").otherwise("no_drawdown")),
        "turnover": (C("notional") / C("average"), None), "longest_drawdown": (C("longest"), None), "recovery": (C("recovery"), F.lit("not_recovered")),
        "benchmark_return": (C("benchmark_return"), F.lit("benchmark_not_available")), "excess_return": (total - C("benchmark_return"), F.lit("benchmark_not_available")),
        "trade_count": (C("trades"), None), "win_rate": (C("win"), F.lit("no_closed_trades")), "profit_factor": (C("won") / C("lost"), F.lit("no_losing_trade")),
        "average_gross": (C("average_gross"), None), "maximum_gross": (C("maximum_gross"), None), "average_net": (C("average_net"), None),
        "total_fees": (C("fees"), None), "total_taxes": (C("taxes"), None), "total_slippage": (C("slippage"), None), "total_carry": (C("carry"), None),
    }
    reasons = [F.when(v.isNull(), r).alias(f"{k}_reason") for k, (v, r) in values.items() if r is not None]
    return g.select(by, *[v.alias(k) for k, (v, _) in values.items()], *reasons)


def window_metrics(points: DataFrame, trades: DataFrame, costs: DataFrame, rates: DataFrame, by: str, lo: str, hi: str) -> DataFrame:
    """metrics of the days from lo to hi, from each account's last point before lo if there is one.

    trades count by the day d they close on, costs by that of their fill.
    """
    inside = lambda d: d.where(C("d").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    before = points.where(C("d") < F.lit(lo).cast("date"))
    last = before.groupBy(by).agg(F.max_by(F.struct(*[c for c in points.columns if c != by]), "d").alias("p")).select(by, "p.*")
    now = inside(points).withColumn("base", F.lit(False))
    # an account without a point in the window has none
    some = now.unionByName(last.join(now.select(by).distinct(), by, "left_semi").withColumn("base", F.lit(True)))
    return metrics(some, inside(trades), inside(costs), rates, by)


def newey_west_by(df: DataFrame, by: list[str], order: str, y: str, x: str | None = None, most: int = 24) -> DataFrame:
    """(by, n, lag, alpha, beta, se_alpha, se_beta): least squares of y on a constant and x (or a constant alone, beta null)
    for each series, with Newey-West errors of lag floor(4 (n/100)^(2/9)), at most `most`.

    Two sums over each series and the products of each row with the rows before it: no matrix leaves the tasks.
    """
    one = Window.partitionBy(*by)
    d = df.where(C(y).isNotNull() & (C(x).isNotNull() if x else F.lit(True))).select(*by, order, C(y).cast("double").alias("y"), (C(x).cast("double") if x else F.lit(0.0)).alias("x"))
    d = d.withColumn("n", F.count("*").over(one)).withColumn("mx", F.avg("x").over(one)).withColumn("my", F.avg("y").over(one))
    d = d.withColumn("u", C("x") - C("mx")).withColumn("sxx", F.sum(C("u") * C("u")).over(one))
    d = d.withColumn("beta", F.try_divide(F.sum(C("u") * C("y")).over(one), C("sxx")) if x else F.lit(None).cast("double"))
    d = d.withColumn("e", C("y") - C("my") - F.coalesce(C("beta") * C("u"), F.lit(0.0))).withColumn("lag", F.least(F.lit(most), F.floor(4 * F.pow(C("n") / 100, 2 / 9))).cast("int"))
    w = Window.partitionBy(*by).orderBy(order)
    # with a centred regressor the constant's and the slope's scores are e and u e
    past = F.collect_list(F.struct("e", (C("u") * C("e")).alias("ue"))).over(w.rowsBetween(-most, -1))
    d = d.withColumn("past", F.reverse(past)).withColumn("ue", C("u") * C("e"))
    weight = lambda i: F.greatest(F.lit(0.0), 1 - (i + 1) / (C("lag") + 1))
    lagged = lambda a, b: F.aggregate(F.transform("past", lambda p, i: weight(i) * p[b]), F.lit(0.0), lambda s, v: s + v) * C(a)
    d = d.withColumn("s00", C("e") * C("e") + 2 * lagged("e", "e")).withColumn("s01", C("e") * C("ue") + lagged("e", "ue") + lagged("ue", "e")).withColumn("s11", C("ue") * C("ue") + 2 * lagged("ue", "ue"))
    g = d.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("lag").alias("lag"), F.first("beta").alias("beta"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("sxx").alias("sxx"),
        F.sum("s00").alias("s00"), F.sum("s01").alias("s01"), F.sum("s11").alias("s11"),
    )
    vb = F.try_divide(C("s11"), C("sxx") * C("sxx"))
    if x is None:
        alpha, va, vb = C("my"), C("s00") / (C("n") * C("n")), F.lit(None).cast("double")
    else:
        alpha = C("my") - C("beta") * C("mx")
        va = C("s00") / (C("n") * C("n")) - 2 * C("mx") * F.try_divide(C("s01"), C("n") * C("sxx")) + C("mx") * C("mx") * vb
    root = lambda v: F.when(v >= 0, F.sqrt(v))
    return g.select(*by, "n", "lag", alpha.alias("alpha"), "beta", root(va).alias("se_alpha"), root(vb).alias("se_beta"))


def mean_difference(df: DataFrame, by: list[str], order: str, a: str, b: str) -> DataFrame:
    """(by, n, lag, difference, t, p): whether the mean of a less b is 0, with a Newey-West error and normal probability, two-sided."""
    r = newey_west_by(df.withColumn("__d", C(a) - C(b)), by, order, "__d")
    t = F.try_divide(C("alpha"), C("se_alpha"))
    return r.select(*by, "n", "lag", C("alpha").alias("difference"), t.alias("t"), (2 * normal_cdf(-F.abs(t))).alias("p"))


def grids(axes: DataFrame, by: list[str], limit: int = 100_000, constraint: str | None = None) -> DataFrame:
    """(by, cell, point, status): the cells of each grid, from axes (by, axis, lo, hi, step): decimals, so that steps are exact.

    point maps an axis to its value. A grid of more than limit cells, or with an axis that has no step or no values, has one
    row that says so. constraint is an expression on point. Cells are numbered in the order of the axes' names and values.
    """
    n = F.when((C("step") > 0) & (C("hi") >= C("lo")), F.floor((C("hi") - C("lo")) / C("step")) + 1).otherwise(0).cast("long")
    a = axes.withColumn("n", n)
    g = a.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "step", "n"))).alias("axes"), F.min("n").alias("least"))
    size = F.aggregate("axes", F.lit(1).cast("double"), lambda s, x: s * x["n"])
    g = g.withColumn("status", F.when(C("least") == 0, "empty_axis").when(size > limit, "too_many_cells").otherwise("ok")).withColumn("size", size)
    cells = g.withColumn("cell", F.explode(F.when(C("status") == "ok", F.sequence(F.lit(0).cast("long"), C("size").cast("long") - 1)).otherwise(F.array(F.lit(None).cast("long")))))
    # a cell's number in mixed radix: the last axis moves fastest
    after = lambda i: F.aggregate(F.slice("axes", i + 2, F.size("axes")), F.lit(1).cast("long"), lambda s, x: s * x["n"])
    value = lambda x, i: x["lo"] + x["step"] * F.pmod(F.floor(C("cell") / after(i)), x["n"]).cast("decimal(18,0)")
    point = F.map_from_arrays(F.transform("axes", lambda x: x["axis"]), F.transform("axes", lambda x, i: value(x, i).cast("double")))
    out = cells.select(*by, "cell", F.when(C("status") == "ok", point).alias("point"), "status")
    return out.where(f"status <> 'ok' OR ({constraint})") if constraint else out


#: Share of a value without a step that its neighbours are away, and cells of a robustness grid at most.
SENSITIVITY, MOST_POINTS = 0.2, 81


def robustness_axes(parameters: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, values): the current value and one step to either side inside its bounds, as decimals without repeats.

    parameters: (by, axis, current, lo, hi, step, whole). Without a step, a fifth of the value; at 0 a tenth of the bounds'
    span; whole parameters are cut to integers.
    """
    dec = lambda c: C(c).cast("decimal(28,9)")
    delta = F.coalesce(dec("step"), F.when(dec("current") != 0, F.abs(dec("current")) * F.lit(SENSITIVITY).cast("decimal(9,6)")).otherwise((dec("hi") - dec("lo")) * F.lit(SENSITIVITY / 2).cast("decimal(9,6)")))
    near = F.array(*[dec("current") + delta.cast("decimal(28,9)") * k for k in (-1, 0, 1)])
    inside = F.filter(near, lambda v: (v >= dec("lo")) & (v <= dec("hi")))
    whole = F.transform(inside, lambda v: F.when(C("whole"), F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")).otherwise(v.cast("double")))
    return parameters.select(*by, "axis", F.array_distinct(whole).alias("values"))


def robustness_cells(axes: DataFrame, by: list[str]) -> DataFrame:
    """(by, cell, point, status) of all combinations of each set's axes, from robustness_axes; too_many_points beyond MOST_POINTS."""
    g = axes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("axis", "values"))).alias("axes"))
    size = F.aggregate("axes", F.lit(1).cast("long"), lambda s, x: s * F.size(x["values"]))
    g = g.withColumn("status", F.when(size > MOST_POINTS, "too_many_points").otherwise("ok")).withColumn("size", size)
    cells = g.withColumn("cell", F.explode(F.when((C("status") == "ok") & (C("size") > 0), F.sequence(F.lit(0).cast("long"), C("size") - 1)).otherwise(F.array(F.lit(None).cast("long")))))
    after = lambda i: F.aggregate(F.slice("axes", i + 2, F.size("axes")), F.lit(1).cast("long"), lambda s, x: s * F.size(x["values"]))
    pick = lambda x, i: F.get(x["values"], F.pmod(F.floor(C("cell") / after(i)), F.size(x["values"])).cast("int"))
    point = F.map_from_arrays(F.transform("axes", lambda x: x["axis"]), F.transform("axes", pick))
    return cells.select(*by, "cell", F.when(C("cell").isNotNull(), point).alias("point"), "status")


def robustness_split(spans: DataFrame, train_years: tuple[int, ...] = (3, 2, 1), test_years: int = 1, slack: int = 14) -> DataFrame:
    """spans (start, end) with train_years: the most years of training that leave a test, null if there are none.

    A span of trading days is some days shorter than its calendar years; slack covers that.
    """
    fits = [F.when(F.date_sub(F.add_months("start", 12 * (t + test_years)), 1 + slack) <= C("end"), t) for t in train_years]
    return spans.withColumn("train_years", F.coalesce(*fits))
