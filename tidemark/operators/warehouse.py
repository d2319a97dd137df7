"""Point-in-time tables: prices, adjustment, universe states, grids with the kind of each cell, financials, disclosures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, versions, windows

C = F.col


def clean_bars(df: DataFrame, policy: str, drop_zero_volume: bool, min_volume: int = 1) -> DataFrame:
    """Bars whose high and low enclose open and close. clamp widens them and drops non-positive prices; strict marks a
    violation as bad instead. Times that do not increase are marked, too."""
    prices = [C(c) for c in ("open", "high", "low", "close")]
    hi, lo = F.greatest(*prices), F.least(*prices)
    broken = (C("high") != hi) | (C("low") != lo)
    d = df.where(C("volume") >= min_volume) if drop_zero_volume else df
    d = d.withColumn("repaired", broken)
    if policy == "strict":
        return d.withColumn("bad", broken | (lo <= 0))
    return d.where(lo > 0).withColumn("__hi", hi).withColumn("__lo", lo).withColumn("high", C("__hi")).withColumn("low", C("__lo")).drop("__hi", "__lo")


def map_accounts(facts: DataFrame, keys: list[str], concept: str, amount: str, rules: dict[str, list[str]]) -> DataFrame:
    """A column for each account from the first of its concepts that is there; several amounts give ambiguous."""
    per = facts.groupBy(*keys, concept).agg(F.collect_set(amount).alias("s"))
    value = F.when(F.size("s") > 1, F.lit("ambiguous")).otherwise(F.element_at("s", 1).cast("string"))
    pick = lambda names: F.coalesce(*[F.max(F.when(C(concept) == n, value)) for n in names])
    return per.groupBy(*keys).agg(*[pick(v).alias(k) for k, v in rules.items()])


def revenue_fallback(facts: DataFrame, keys: list[str], concept: str, amount: str, direct: str, parts: list[str]) -> DataFrame:
    """The direct concept, or the sum of all parts if each is there; basis says which."""
    d = facts.groupBy(*keys).agg(
        F.sum(F.when(C(concept) == direct, C(amount))).alias("direct"),
        F.sum(F.when(C(concept).isin(parts), C(amount))).alias("summed"),
        F.collect_set(F.when(C(concept).isin(parts), C(concept))).alias("there"),
    )
    whole = F.size("there") == len(parts)
    basis = F.when(C("direct").isNotNull(), "direct").when(whole, "summed")
    return d.select(*keys, basis.alias("basis"), F.when(C("direct").isNotNull(), C("direct")).when(whole, C("summed")).alias("revenue"))


def pivot_preferred(df: DataFrame, keys: list[str], kind: str, amount: str, order: list[str]) -> DataFrame:
    """The amount of the first kind in order that is there, and which it was."""
    wide = df.groupBy(*keys).agg(*[F.max(F.when(C(kind) == k, C(amount))).alias(f"__{i}") for i, k in enumerate(order)])
    basis = F.coalesce(*[F.when(C(f"__{i}").isNotNull(), k) for i, k in enumerate(order)])
    return wide.select(*keys, F.coalesce(*[C(f"__{i}") for i in range(len(order))]).alias("amount"), basis.alias("basis"))


def security_span(df: DataFrame, by: list[str], idx: str, last_idx: int | Column) -> DataFrame:
    """Runs of sessions; a run that ends before the last session ends by a gap or, if no run follows, by delisting."""
    s = windows.islands(df, by, idx)
    more = F.lead("first").over(Window.partitionBy(*by).orderBy("span_seq")).isNotNull()
    return s.withColumn("end_reason", F.when(more, "coverage_gap").when(C("last") < last_idx, "delisted"))


def detect_splits(df: DataFrame, by: list[str], order: str, shares: str, price: str) -> DataFrame:
    """Share counts that jump by 1.5 or more (or to 2/3 or less) while the price moves the other way."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("ratio", C(shares) / F.lag(shares).over(w)).withColumn("move", C(price) / F.lag(price).over(w))
    jump = (C("ratio") >= 1.5) | (C("ratio") <= 1 / 1.5)
    return d.where(jump & (C("move") * C("ratio")).between(0.5, 2.0))


def adj_factor(events: DataFrame, jumps: DataFrame, by: list[str], at: str, window: int, tolerance: float) -> DataFrame:
    """Each event's factor with where it comes from: the jump on its own day (nominal), one near by (window), the product
    of several events on one jump (combined), or its own ratio (raw); conflict where a jump on the day disagrees.

    events: (by, at, ratio); jumps: (by, at, ratio).
    """
    j = jumps.select(*by, C(at).alias("j_at"), C("ratio").alias("j_ratio"))
    near = lambda a, b: F.abs(a / b - 1) <= tolerance
    same = events.join(j.withColumnRenamed("j_at", at), [*by, at], "left")
    nominal = same.where(near(C("j_ratio"), C("ratio"))).select(*by, at, C("j_ratio").alias("n_ratio"))
    group = events.groupBy(*by, at).agg(F.product("ratio").alias("all"), F.count("*").alias("k"))
    combined = group.where("k > 1").join(j.withColumnRenamed("j_at", at), [*by, at]).where(near(C("j_ratio"), C("all"))).select(*by, at, F.lit(True).alias("combined"))
    left = events.join(nominal, [*by, at], "left_anti").join(combined, [*by, at], "left_anti")
    win = joins.match_best(left.select(*by, at, C("ratio").alias("v")), jumps.select(*by, at, C("ratio").alias("v")), by, at, "v", window, tolerance)
    win = win.select(*by, C("u_at").alias(at), C("s_at").alias("found_at"), C("s_value").alias("w_ratio"))
    out = same.join(nominal.dropDuplicates([*by, at]), [*by, at], "left").join(combined, [*by, at], "left").join(win, [*by, at], "left")
    source = F.when(C("combined"), "combined").when(near(C("n_ratio"), C("ratio")), "nominal").when(C("w_ratio").isNotNull(), "window").when(C("j_ratio").isNotNull(), "conflict").otherwise("raw")
    return out.select(*by, at, "ratio", F.coalesce("found_at", at).alias("apply_at"), source.alias("factor_source"), F.when(source == "window", C("w_ratio")).otherwise(C("ratio")).alias("factor"), (source != "conflict").alias("factor_ok"))


def adjusted_forward(prices: DataFrame, factors: DataFrame, by: list[str], at: str, price: str) -> DataFrame:
    """Prices times the product of all factors up to their session, so a split makes no step."""
    f = factors.groupBy(*by, at).agg(F.product("factor").alias("f"))
    run = f.withColumn("cum", F.product("f").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    j = joins.asof_backward(prices, run.select(*by, at, "cum"), by, at, ["cum"])
    return j.withColumn("factor", F.coalesce("cum", F.lit(1.0))).withColumn("adj", C(price) * C("factor")).drop("cum", f"{at}_matched")


def adjusted_as_of(prices: DataFrame, factors: DataFrame, by: list[str], at: str, price: str, as_of) -> DataFrame:
    """Prices up to as_of divided by the product of the factors that come after their session and were known by then."""
    f = factors.where((C(at) <= F.lit(as_of))).groupBy(*by, at).agg(F.product("factor").alias("f"))
    run = f.withColumn("cum", F.product("f").over(Window.partitionBy(*by).orderBy(at).rowsBetween(0, Window.unboundedFollowing)))
    shifted = run.select(*by, (C(at) - 1).alias(at), "cum")  # a factor holds for the sessions before its own
    j = joins.asof_forward(prices.where(C(at) <= F.lit(as_of)), shifted, by, at, ["cum"])
    return j.withColumn("factor", F.coalesce("cum", F.lit(1.0))).withColumn("adj", C(price) / C("factor")).drop("cum", f"{at}_matched")


def cell_kind(value: Column, covered: Column, asked: Column) -> Column:
    """Why a grid cell is as it is: measured, src_omitted (its source covers the day), empty_response (asked in vain), not_collected."""
    kind = F.when(value.isNotNull(), "measured").when(covered, "src_omitted").when(asked, "empty_response").otherwise("not_collected")
    return F.struct(kind.alias("kind"), F.when(kind != "measured", F.concat(F.lit("no value: "), kind)).alias("evidence"))


def universe_daily(df: DataFrame, by: list[str], idx: str, halt: Column, resume: Column, traded: Column, liquid: Column, adv: str, n: int) -> DataFrame:
    """State of each security and session: halted since the last halt event, run of sessions without trade, average value
    traded, liquidity rank among the tradable, and a status."""
    w = Window.partitionBy(*by).orderBy(idx)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("halt_idx", F.max(F.when(halt, C(idx))).over(run)).withColumn("resume_idx", F.max(F.when(resume, C(idx))).over(run))
    d = d.withColumn("halted", F.coalesce(C("halt_idx") > F.coalesce("resume_idx", F.lit(-1)), F.lit(False)))
    d = d.withColumn("last_trade", F.max(F.when(traded, C(idx))).over(run))
    d = d.withColumn("no_trade_run", C(idx) - F.coalesce("last_trade", F.min(idx).over(Window.partitionBy(*by)) - 1))
    back = w.rowsBetween(-(n - 1), 0)
    d = d.withColumn("adv", F.when(F.count(adv).over(back) == n, F.avg(adv).over(back)))
    d = d.withColumn("status", F.when(C("halted"), "halted").when(C("no_trade_run") > 0, "no_trade").when(~F.coalesce(liquid, F.lit(False)), "illiquid").otherwise("normal"))
    return windows.liquidity_rank(d, [idx], "adv", C("adv").isNotNull() & (C("status") == "normal"))


def latest_financials(facts: DataFrame, by: list[str], period: str, available: str, value: str, as_of, quarters: int = 4) -> DataFrame:
    """For each period known by as_of: the latest vintage, the standalone change over the period before, and the sum of
    the last four quarters if these are consecutive."""
    known = versions.latest_per_key(facts.where(C(available) <= F.lit(as_of)), [*by, period], [available])
    q = F.year(period) * 4 + F.quarter(period)
    w = Window.partitionBy(*by).orderBy("__q")
    d = known.withColumn("__q", q)
    back = w.rowsBetween(-(quarters - 1), 0)
    whole = (F.count(value).over(back) == quarters) & (C("__q") - F.min("__q").over(back) == quarters - 1)
    d = d.withColumn("ttm", F.when(whole, F.sum(value).over(back)))
    d = d.withColumn("change", F.when(F.lag("__q").over(w) == C("__q") - 1, C(value) - F.lag(value).over(w)))
    return d.drop("__q")


def snapshot_as_of(df: DataFrame, by: list[str], day: str, as_of) -> DataFrame:
    """The last row of each key up to as_of, with its age in days."""
    return versions.latest_per_key(df.where(C(day) <= F.lit(as_of)), by, [day]).withColumn("age_days", F.datediff(F.lit(as_of), C(day)))


def snap_to_session(df: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """A day's last session at or before it."""
    # each session stands for the days up to the next one; the last for 400 more
    days = F.explode(F.expr("sequence(d, coalesce(date_sub(next_d, 1), date_add(d, 400)))"))
    span = calendar.select(C("d").alias("session"), days.alias(day))
    return df.join(F.broadcast(span), day, "left")


def membership_intervals(df: DataFrame, calendar: DataFrame, by: list[str], day: str) -> DataFrame:
    """(by, from, to) of daily membership; a session without a row ends the interval."""
    d = df.select(*by, day).distinct().join(F.broadcast(calendar.select(C("d").alias(day), "idx")), day)
    run = C("idx") - F.row_number().over(Window.partitionBy(*by).orderBy("idx"))
    return d.withColumn("run", run).groupBy(*by, "run").agg(F.min(day).alias("from"), F.max(day).alias("to")).drop("run")


def ticker_spans(*tables: DataFrame) -> DataFrame:
    """(sid, first, last) over several tables of (sid, d)."""
    out = tables[0].select("sid", "d")
    for t in tables[1:]:
        out = out.unionByName(t.select("sid", "d"))
    return out.groupBy("sid").agg(F.min("d").alias("first"), F.max("d").alias("last"))


def disclosure_version(df: DataFrame, by: list[str], filed: str, id_: str, correction: Column, period_end: str, days: int) -> DataFrame:
    """Kind, original and delay of each filing: late ones were filed more than so many days after the period's end."""
    linked = joins.link_corrections(df, by, filed, id_, correction).select(id_, "original", "candidates")
    d = df.join(linked, id_, "left").withColumn("kind", F.when(correction, "correction").otherwise("original"))
    d = d.withColumn("deadline", F.date_add(period_end, days))
    return d.withColumn("delay_days", F.greatest(F.lit(0), F.datediff(filed, "deadline")))


def dataset_profile(df: DataFrame, day: str, fields: list[str], units: dict[str, str]) -> DataFrame:
    """(field, unit, first, last, covered, share) of each field."""
    one = lambda f: F.struct(F.lit(f).alias("field"), F.lit(units.get(f)).alias("unit"), F.min(F.when(C(f).isNotNull(), C(day))).alias("first"), F.max(F.when(C(f).isNotNull(), C(day))).alias("last"), F.count(f).alias("covered"), (F.count(f) / F.count("*")).alias("share"))
    return df.agg(F.array(*[one(f) for f in fields]).alias("a")).select(F.inline("a"))


def factor_readiness(profile: DataFrame, needs: dict[str, list[str]], min_share: float) -> DataFrame:
    """(factor, ready, blocked): which fields keep a factor from being computed."""
    spark = profile.sparkSession
    rows = spark.createDataFrame([(f, x) for f, xs in needs.items() for x in xs], "factor string, field string")
    j = rows.join(profile.select("field", "share"), "field", "left")
    bad = F.array_sort(F.collect_set(F.when(F.coalesce(C("share"), F.lit(0.0)) < min_share, C("field"))))
    return j.groupBy("factor").agg(bad.alias("b")).select("factor", (F.size("b") == 0).alias("ready"), F.array_join("b", ",").alias("blocked"))
