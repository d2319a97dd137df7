"""Portfolios, risk and market reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


C = F.col


# ---- portfolios


def select_names(df: DataFrame, keys: list[str], score: str, tie: str, id_: str, n: int, short: bool = False) -> DataFrame:
    """The n highest scores as long side (short: the n lowest, too, as short side); ties by the tie-break, missing last, then id."""
    order = lambda s: [s, C(tie).desc_nulls_last(), C(id_)]
    d = df.where(C(score).isNotNull())
    w = Window.partitionBy(*keys)
    d = d.withColumn("__hi", F.row_number().over(w.orderBy(*order(C(score).desc())))).withColumn("__lo", F.row_number().over(w.orderBy(*order(C(score).asc()))))
    side = F.when(C("__hi") <= n, "long")
    d = d.withColumn("side", side.when(C("__lo") <= n, "short") if short else side).where("side IS NOT NULL")
    return d.withColumn("rank", F.when(C("side") == "long", C("__hi")).otherwise(C("__lo"))).drop("__hi", "__lo")


def weights(df: DataFrame, keys: list[str], method: str, score: str = "score", risk: str = "risk") -> DataFrame:
    """equal, score, rank or inverse_risk weights that add up to one in each key."""
    w = Window.partitionBy(*keys)
    raw = {"equal": F.lit(1.0), "score": C(score), "rank": F.max("rank").over(w) + 1.0 - C("rank"), "inverse_risk": F.try_divide(F.lit(1.0), C(risk))}[method]
    d = df.withColumn("__raw", raw)
    return d.withColumn("weight", F.try_divide(C("__raw"), F.sum("__raw").over(w))).drop("__raw")


def cap_weights(df: DataFrame, keys: list[str], cap: float, rounds: int = 8) -> DataFrame:
    """Weights held to cap; what is cut goes to those under it in proportion, in a fixed number of rounds."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("__w", C("weight"))
    for _ in range(rounds):
        d = d.withColumn("__c", F.least(C("__w"), F.lit(cap)))
        d = d.withColumn("__over", F.sum(C("__w") - C("__c")).over(w)).withColumn("__room", F.sum(F.when(C("__c") < cap, C("__c")).otherwise(0.0)).over(w))
        d = d.withColumn("__w", F.when((C("__c") < cap) & (C("__room") > 0), C("__c") + C("__over") * C("__c") / C("__room")).otherwise(C("__c"))).drop("__c", "__over", "__room")
    return d.withColumn("weight", F.least(C("__w"), F.lit(cap))).drop("__w")


def rebalance_dates(calendar: DataFrame, rule: str, n: int = 1) -> DataFrame:
    """(signal, execution): the last session of each week, month or quarter, or every n-th; executed the next session."""
    if rule == "sessions":
        d = calendar.where(C("idx") % n == 0)
    else:
        w = Window.partitionBy(F.date_trunc(rule, "d")).orderBy(F.desc("d"))
        d = calendar.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return d.where("next_d IS NOT NULL").select(C("d").alias("signal"), C("next_d").alias("execution"))


def buffer_targets(df: DataFrame, portfolio: str, frame: str, name: str, weight: str, least: float) -> DataFrame:
    """Targets that move from what is held only if the change is at least so much. A portfolio's frames are a sequence, so
    each portfolio is one group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        out = []
        for f, rows in g.sort_values([frame, name]).groupby(frame, sort=True):
            want = dict(zip(rows[name], rows[weight], strict=True))
            now = {k: (want.get(k, 0.0) if abs(want.get(k, 0.0) - held.get(k, 0.0)) >= least else held.get(k, 0.0)) for k in {*want, *held}}
            held = {k: v for k, v in now.items() if v}
            out += [(g[portfolio].iloc[0], f, k, v) for k, v in sorted(held.items())]
        return pd.DataFrame(out, columns=[portfolio, frame, name, weight])

    s = df.select(portfolio, frame, name, C(weight).cast("double").alias(weight))
    return s.groupBy(portfolio).applyInPandas(run, s.schema)


def plan_rebalance(df: DataFrame, keys: list[str], slots: int, keep_rank: int) -> DataFrame:
    """Actions from (rank, held, blocked, price): sell, keep or buy. Held names with a rank up to keep_rank stay; free slots go to
    the best names that are not held, not blocked and have a price."""
    keep = C("held") & (F.coalesce(C("rank") <= keep_rank, F.lit(False)) | C("blocked"))
    d = df.withColumn("__keep", keep)
    free = slots - F.sum(C("__keep").cast("int")).over(Window.partitionBy(*keys))
    can = ~C("held") & ~C("blocked") & C("price").isNotNull() & C("rank").isNotNull()
    d = d.withColumn("__can", can)
    place = F.row_number().over(Window.partitionBy(*keys, "__can").orderBy(C("rank").asc_nulls_last()))
    action = F.when(C("__keep"), "keep").when(C("held"), "sell").when(C("__can") & (place <= free), "buy")
    return d.withColumn("action", action).where("action IS NOT NULL").drop("__keep", "__can")


def guard_targets(df: DataFrame, max_weight: float, adv_share: float) -> DataFrame:
    """Targets cut to the limits, with reasons: halted and blocked names get nothing."""
    out = F.when(C("halted") | C("blocked"), F.lit(0.0)).otherwise(F.least(C("weight"), F.lit(max_weight), C("adv") * adv_share))
    why = F.array_compact(F.array(F.when(C("halted"), "halted"), F.when(C("blocked"), "blocked"), F.when(C("weight") > max_weight, "weight_cap"), F.when(C("weight") > C("adv") * adv_share, "adv_cap")))
    return df.withColumn("target", out).withColumn("reasons", F.array_join(why, ","))


def closed_trades(fills: DataFrame, by: str, order: str, qty: str, price: str, fee: float = 0.0, splits: DataFrame | None = None, tax: str | None = None) -> DataFrame:
    """Sales against the average cost of what is held: (by, order, qty, cost, proceeds, profit); at most what is held is sold.

    splits (by, order, ratio) multiply what is held before the fills of their time, at the same cost. tax names a column
    with the rate on a sale. fee is a share of each side. The average depends on all fills before, so a security's are one
    group.
    """
    null = lambda: F.lit(None).cast("double")
    rate = C(tax).cast("double") if tax else F.lit(0.0)
    rows = fills.select(by, order, C(qty).cast("double").alias("__q"), C(price).cast("double").alias("__p"), rate.alias("__tax"), null().alias("__ratio"))
    if splits is not None:
        rows = rows.unionByName(splits.select(by, order, null().alias("__q"), null().alias("__p"), null().alias("__tax"), C("ratio").cast("double").alias("__ratio")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        held, cost, out = 0.0, 0.0, []
        g = g.assign(late=g["__ratio"].isna()).sort_values([order, "late"], kind="stable")
        for o, q, p, t, ratio in g[[order, "__q", "__p", "__tax", "__ratio"]].itertuples(index=False):
            if ratio == ratio:
                held *= ratio
            elif q > 0:
                cost += q * p * (1 + fee)
                held += q
            elif q < 0 and held > 0:
                n = min(held, -q)
                part = cost * n / held
                got = n * p * (1 - fee - t)
                out.append((g[by].iloc[0], o, n, part, got, got - part))
                held, cost = held - n, cost - part
        return pd.DataFrame(out, columns=[by, order, "qty", "cost", "proceeds", "profit"])

    t = dict(fills.dtypes)
    return rows.groupBy(by).applyInPandas(run, f"{by} {t[by]}, {order} {t[order]}, qty double, cost double, proceeds double, profit double")


def portfolio_returns(w: DataFrame, returns: DataFrame, keys: list[str], name: str, limit: float) -> DataFrame:
    """Sum of weight times return; null if a return is missing or beyond the price limit."""
    j = w.join(returns, [*keys, name], "left")
    ok = C("ret").isNotNull() & (F.abs("ret") <= limit)
    return j.groupBy(*keys).agg(F.when(F.bool_and(F.coalesce(ok, F.lit(False))), F.sum(C("weight") * C("ret"))).alias("ret"), F.count("*").alias("names"))


def session_holdings(df: DataFrame, by: list[str], idx: str, qty: str) -> DataFrame:
    """What changed at each session: new, added, reduced, unchanged or closed."""
    before = df.select(*by, (C(idx) + 1).alias(idx), C(qty).alias("before"))
    last = df.agg(F.max(idx).alias("__last"))
    j = df.select(*by, idx, qty).join(before, [*by, idx], "full_outer").join(F.broadcast(last)).where(C(idx) <= C("__last"))
    x, y = F.coalesce(qty, F.lit(0)), F.coalesce("before", F.lit(0))
    label = F.when(x == 0, "closed").when(y == 0, "new").when(x > y, "added").when(x < y, "reduced").otherwise("unchanged")
    return j.select(*by, idx, x.alias(qty), label.alias("change"))


def impact_scale(df: DataFrame, by: list[str], idx: str, ret: str, adv: str, n: int, order_value: float) -> DataFrame:
    """Square-root impact: volatility before today times the root of the order over the average value traded before today."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(-n, -1)
    full = F.count(ret).over(w) >= max(2, n // 2)
    return df.withColumn("impact", F.when(full, F.stddev_samp(ret).over(w) * F.sqrt(F.try_divide(F.lit(order_value), F.avg(adv).over(w)))))


def execution_quality(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Shortfall of fills against the decision price in basis points, and the value not traded."""
    cost = C("filled") * (C("price") - C("decision")) * F.when(C("side") == "buy", 1).otherwise(-1)
    return fills.groupBy(*keys).agg((F.try_divide(F.sum(cost), F.sum(C("filled") * C("decision"))) * 10_000).alias("shortfall_bp"), F.sum((C("wanted") - C("filled")) * C("decision")).alias("missed"))


# ---- risk


def risk_windows(df: DataFrame, by: list[str], order: str, ret: str, index: str, windows: list[int], year: int = 252) -> DataFrame:
    """(by, window, volatility, beta) over the last n rows for each n."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    d = df.withColumn("__r", last).withColumn("window", F.explode(F.array(*map(F.lit, windows)))).where(C("__r") <= C("window"))
    return d.groupBy(*by, "window").agg((F.stddev_samp(ret) * math.sqrt(year)).alias("volatility"), F.regr_slope(ret, index).alias("beta"))


def tail_stat(df: DataFrame, by: list[str], x: str, share: float) -> DataFrame:
    """Mean and cut-off of the worst ceil(share n)."""
    w = Window.partitionBy(*by)
    d = df.where(C(x).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(x))).withColumn("__n", F.count("*").over(w))
    return d.where(C("__r") <= F.ceil(C("__n") * share)).groupBy(*by).agg(F.avg(x).alias("tail_mean"), F.max(x).alias("cutoff"), F.count("*").alias("n"))


def concentration(df: DataFrame, by: list[str], weight: str, id_: str) -> DataFrame:
    d = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(weight), id_)))
    return d.groupBy(*by).agg(*[F.sum(F.when(C("__r") <= n, C(weight))).alias(f"top{n}") for n in (1, 3, 5)], (1 - F.sum(weight)).alias("cash"))


def drawdown_state(df: DataFrame, account: str, order: str, equity: str, limits: tuple[float, float, float], recover: float, actions: DataFrame | None = None) -> DataFrame:
    """(account, order, level, peak, loss) after each close: 0 normal, 1 warn, 2 reduce, 3 halt by the limits.

    * A halt begins with a close whose loss crosses the third limit from below, and lasts until an action.
    * Reducing begins with a loss at the second limit or a resumed halt, and ends with a loss under recover.
    * A warning is given at a loss of the first limit.

    actions: (account, order, kind, peak): "reset" starts anew from a peak, "resume" ends a halt; one on the day of a close
    comes after it. Halts are spans from a crossing to the next action, reducing is what its last begin or end says: windows
    over the account's closes and actions in one order.
    """
    warn, reduce, halt = limits
    rows = df.select(account, order, C(equity).cast("double").alias("__e"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("__p"))
    if actions is not None:
        rows = rows.unionByName(actions.select(account, order, F.lit(None).cast("double").alias("__e"), "kind", C("peak").cast("double").alias("__p")))
    timeline = [C(order), C("kind").isNotNull()]
    so_far = Window.partitionBy(account).orderBy(*timeline).rowsBetween(Window.unboundedPreceding, 0)
    # a reset opens an era with its peak; an action closes a spell, and the next one begins unhalted
    d = rows.withColumn("__era", F.count_if(F.coalesce(C("kind") == "reset", F.lit(False))).over(so_far))
    d = d.withColumn("__spell", F.count("kind").over(so_far) - C("kind").isNotNull().cast("int"))
    era = Window.partitionBy(account, "__era").orderBy(*timeline)
    spell = Window.partitionBy(account, "__spell").orderBy(*timeline)
    d = d.withColumn("peak", F.max(F.coalesce("__e", "__p")).over(era.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("loss", 1 - C("__e") / C("peak"))
    before = F.coalesce(F.last("loss", True).over(era.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = d.withColumn("__crossed", F.coalesce((before < halt) & (C("loss") >= halt), F.lit(False)))
    d = d.withColumn("__halted", F.max("__crossed").over(spell.rowsBetween(Window.unboundedPreceding, 0)))
    says = F.when((C("loss") >= reduce) | ((C("kind") == "resume") & C("__halted")), True).when((C("loss") < recover) | (C("kind") == "reset"), False)
    d = d.withColumn("__reducing", F.coalesce(F.last(says, True).over(so_far), F.lit(False)))
    level = F.when(C("__halted"), 3).when(C("__reducing"), 2).when(C("loss") >= warn, 1).otherwise(0)
    return d.where("kind IS NULL").select(account, order, level.alias("level"), "peak", "loss")


def temperature(parts: DataFrame, idx: str, names: list[str], n: int, least: int) -> DataFrame:
    """(idx, temperature): the mean, from 0 to 100, of where each part's value stands among its last n (itself included, equal
    ones half); null if a part is missing or has fewer than least values. parts has a row a session."""
    w = Window.orderBy(idx).rowsBetween(-(n - 1), 0)

    def place(c: str) -> Column:
        cells = F.collect_list(c).over(w)
        below, equal = F.size(F.filter(cells, lambda x: x < C(c))), F.size(F.filter(cells, lambda x: x == C(c)))
        return F.when(C(c).isNotNull() & (F.size(cells) >= least), (below + 0.5 * equal) / F.size(cells))

    first, *rest = map(place, names)
    return parts.select(idx, (sum(rest, first) / len(names) * 100).alias("temperature"))


def panic_fraction(df: DataFrame, day: str, rsi: str, below: float = 30.0) -> DataFrame:
    """(day, panic): the share of names with a strength index under a bound among those that have one."""
    return df.where(C(rsi).isNotNull() & ~F.isnan(rsi)).groupBy(day).agg(F.avg((C(rsi) < below).cast("double")).alias("panic"))


# ---- market


def breadth(df: DataFrame, by: str, idx: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(idx)
    back = w.rangeBetween(-(n - 1), 0)
    d = df.withColumn("__p", F.lag("close").over(w)).withColumn("__hi", C("close") >= F.max("high").over(back)).withColumn("__lo", C("close") <= F.min("low").over(back))
    return d.groupBy(idx).agg(F.count_if(C("close") > C("__p")).alias("up"), F.count_if(C("close") < C("__p")).alias("down"), F.count_if(C("close") == C("__p")).alias("flat"), F.count_if("__hi").alias("highs"), F.count_if("__lo").alias("lows"))


def flow_summary(df: DataFrame, market: str, day: str, columns: list[str], sessions: list[int]) -> DataFrame:
    """Sums over the newest n sessions of each market, for each n."""
    r = F.dense_rank().over(Window.partitionBy(market).orderBy(F.desc(day)))
    d = df.groupBy(market, day).agg(*[F.sum(c).alias(c) for c in columns]).withColumn("__r", r)
    return d.groupBy(market).agg(*[F.sum(F.when(C("__r") <= n, C(c))).alias(f"{c}_{n}") for c in columns for n in sessions])


def latest_complete(df: DataFrame, day: str, share: float) -> DataFrame:
    """Days with whether they have at least a share of the rows of the day before."""
    n = df.groupBy(day).agg(F.count("*").alias("n"))
    return n.withColumn("complete", F.coalesce(C("n") >= share * F.lag("n").over(Window.orderBy(day)), F.lit(True)))


def etf_flows(df: DataFrame, by: str, idx: str, shares: str, nav: str) -> DataFrame:
    """Change of shares times net asset value; a change that a split explains is none; the first day opens a fund.

    A ratio to nothing is unknown, and so explains no change.
    """
    w = Window.partitionBy(by).orderBy(idx)
    ds, dn = F.try_divide(shares, F.lag(shares).over(w)), F.try_divide(nav, F.lag(nav).over(w))
    split = ((ds >= 1.9) | (ds <= 0.55)) & (ds * dn).between(0.8, 1.25)
    flow = (C(shares) - F.lag(shares).over(w)) * C(nav)
    return df.select(by, idx, F.when(F.lag(shares).over(w).isNull(), None).when(split, 0.0).otherwise(flow).alias("flow"), F.lag(shares).over(w).isNull().alias("opened"))


def decile_odds(df: DataFrame, by: str, idx: str, score: str, price: str, horizon: int, hold_out: Column) -> DataFrame:
    """(decile, n, odds, mean) of the return to horizon sessions later, against the base rate, without held-out rows.

    A fall to a price of 0 is a return of -1; from a price of 0 there is none.
    """
    w = Window.partitionBy(by).orderBy(idx)
    d = df.withColumn("fwd", F.try_divide(F.lead(price, horizon).over(w), price) - 1).where(~hold_out).where("fwd IS NOT NULL")
    d = d.withColumn("decile", F.ntile(10).over(Window.partitionBy(idx).orderBy(score, by)))
    base = d.agg(F.avg((C("fwd") > 0).cast("int")).alias("base"))
    g = d.groupBy("decile").agg(F.count("*").alias("n"), F.avg((C("fwd") > 0).cast("int")).alias("odds"), F.avg("fwd").alias("mean"))
    return g.join(F.broadcast(base))
