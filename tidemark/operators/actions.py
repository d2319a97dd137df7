"""Corporate actions against the base prices that an exchange sets: which action moved the price on which session.

A session whose base price differs from the close before it is a jump; only jumps can take a factor. Each action looks for
its jump in three ways, one after the other, and each jump belongs to one action or to none:

* nominal: on the first session from its effective date on;
* price_matched: the jump that fits best in a window around it;
* price_matched_combined: actions close to each other that found nothing alone, by the product of their ratios.

What is left has a reason, jumps without an action become rows of their own, and unresolved jumps still give a factor for
prices alone. Candidates are met in cells of the window's width, so work grows with actions and jumps, not their product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


@dataclass(frozen=True)
class Rules:
    """Relative and absolute tolerance of the fit, sessions before and after, and what counts as a jump or a change of shares."""

    relative: float = 0.15
    absolute: float = 0.05
    lookback: int = 5
    window: int = 20
    jump: float = 0.01
    shares: float = 0.001
    product: float = 0.05


def jumps(prices: DataFrame, by: list[str], idx: str, rules: Rules) -> DataFrame:
    """(by, j_idx, r, change, quiet) of the sessions whose base price over the close before is off 1 by more than rules.jump.

    change is the share count over the one before, if it moved; quiet says that the session before had no trade. A
    security's first session has no close before it and is none.
    """
    w = Window.partitionBy(*by).orderBy(idx)
    r = F.try_divide(C("base"), F.lag("close").over(w))
    change = F.try_divide(C("shares").cast("double"), F.lag("shares").over(w))
    d = prices.select(*by, C(idx).alias("j_idx"), r.alias("r"), F.when(F.abs(change - 1) > rules.shares, change).alias("change"), (F.lag("volume").over(w) == 0).alias("quiet"))
    return d.where(F.abs(C("r") - 1) > rules.jump)


def _fit(r: Column, factor: Column) -> Column:
    return F.abs(r / factor - 1)


def _tolerance(factor: Column, rules: Rules) -> Column:
    """Wider for larger moves; no less than rules.absolute."""
    return F.greatest(rules.relative * F.abs(F.least(factor, 1 / factor) - 1), F.lit(rules.absolute))


def _nearest(units: DataFrame, found: DataFrame, by: list[str], rules: Rules) -> DataFrame:
    """For units (by, unit, lo, hi, at, factor) the jump in [lo, hi] that fits best within tolerance: (by, unit, at, j_idx, fit)."""
    width = rules.lookback + rules.window + 1
    u = units.withColumn("__cell", F.explode(F.sequence(F.floor(C("lo") / width), F.floor(C("hi") / width))))
    j = found.select(*by, "j_idx", "r", F.floor(C("j_idx") / width).alias("__cell"))
    m = u.join(j, [*by, "__cell"]).where(C("j_idx").between(C("lo"), C("hi"))).withColumn("fit", _fit(C("r"), C("factor")))
    m = m.where(C("fit") <= _tolerance(C("factor"), rules))
    best = F.row_number().over(Window.partitionBy(*by, "unit").orderBy("fit", F.abs(C("j_idx") - C("at")), "j_idx"))
    return m.withColumn("__r", best).where("__r = 1").select(*by, "unit", "at", "j_idx", "fit")


def resolve(events: DataFrame, prices: DataFrame, by: list[str], idx: str, rules: Rules = Rules()) -> DataFrame:
    """(by, event_id, nominal_idx, apply_idx, basis, resolution, factor_ok, price_factor, share_factor, price_only_factor).

    events: (by, event_id, nominal_idx, ratio), ratio the shares after over those before; prices: (by, idx, close, base,
    shares, volume). basis says how the jump was found (nominal, price_matched, price_matched_combined, jump for a row made
    of a jump, unmatched). resolution is one of

    * factor: the jump's own ratio is the price factor, the change of shares (or its inverse) the share factor;
    * base_inconsistent: found, but price and shares together do not keep the value;
    * same_day_suppressed: another action fits that jump better; ratio_null, no_share_change; no_price_match;
    * unknown_base: a jump with a fitting change of shares and no action; unknown_price_only: a jump without one.

    A jump after a session without trade and without a change of shares is only a price found again and makes no row.
    Where factor_ok is false both factors are 1; price_only_factor then still holds the jump of an unresolved session, once.
    """
    found = jumps(prices, by, idx, rules)
    e = events.select(*by, "event_id", "nominal_idx", C("ratio").cast("double").alias("ratio"))
    reason = F.when(C("ratio").isNull() | (C("ratio") <= 0), "ratio_null").when(C("ratio") == 1, "no_share_change")
    e = e.withColumn("reason", reason).withColumn("factor", F.when(C("reason").isNull(), 1 / C("ratio")))
    e = e.withColumn("small", F.abs(F.least("factor", 1 / C("factor")) - 1) <= rules.absolute)
    able = e.where("reason IS NULL").withColumn("at", C("nominal_idx")).withColumn("unit", C("event_id"))
    first = _nearest(able.select(*by, "unit", "at", C("at").alias("lo"), C("at").alias("hi"), "factor"), found, by, rules).withColumn("basis", F.lit("nominal"))
    rest = able.where("NOT small").join(first.select(*by, "unit"), [*by, "unit"], "left_anti")
    spans = rest.select(*by, "unit", "at", (C("at") - rules.lookback).alias("lo"), (C("at") + rules.window).alias("hi"), "factor")
    second = _nearest(spans, found, by, rules).withColumn("basis", F.lit("price_matched"))
    # actions still without a jump, in runs whose neighbours are at most a window apart
    alone = rest.join(second.select(*by, "unit"), [*by, "unit"], "left_anti")
    w = Window.partitionBy(*by).orderBy("at", "event_id")
    new = F.when(C("at") - F.lag("at").over(w) <= rules.window, 0).otherwise(1)
    alone = alone.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = alone.groupBy(*by, "run").agg(F.min("event_id").alias("unit"), F.min("at").alias("a"), F.max("at").alias("b"), F.product("factor").alias("factor"), F.count("*").alias("n"))
    runs = runs.where("n > 1")
    joint = _nearest(runs.select(*by, "unit", C("a").alias("at"), (C("a") - rules.lookback).alias("lo"), (C("b") + rules.window).alias("hi"), "factor"), found, by, rules)
    members = alone.join(runs.select(*by, "run", C("unit").alias("root")), [*by, "run"]).select(*by, "event_id", "root", C("factor").alias("own"))
    third = joint.withColumn("basis", F.lit("price_matched_combined"))
    # a jump belongs to the unit that fits it best
    units = first.unionByName(second).unionByName(third)
    owner = F.row_number().over(Window.partitionBy(*by, "j_idx").orderBy("fit", F.abs(C("j_idx") - C("at")), "unit"))
    units = units.withColumn("owns", owner == 1).join(found, [*by, "j_idx"])
    single = units.where("basis <> 'price_matched_combined'").withColumn("event_id", C("unit"))
    pooled = units.where("basis = 'price_matched_combined'").join(members.withColumnRenamed("root", "unit"), [*by, "unit"])
    # of a run the first action takes what the others leave of the jump
    others = F.product("own").over(Window.partitionBy(*by, "unit")) / C("own")
    pooled = pooled.withColumn("r_own", F.when(C("event_id") == C("unit"), C("r") / others).otherwise(C("own")))
    change = F.when(C("event_id") == C("unit"), F.coalesce(C("change"), 1 / C("r")) * others).otherwise(1 / C("own"))
    pooled = pooled.withColumn("s_own", change)
    single = single.withColumn("r_own", C("r")).withColumn("s_own", F.coalesce("change", 1 / C("r")))
    keep = [*by, "event_id", "j_idx", "basis", "owns", "r", "change", "r_own", "s_own"]
    placed = single.select(keep).unionByName(pooled.select(keep))
    sound = F.abs(C("r") * F.coalesce(C("change"), 1 / C("r")) - 1) <= rules.product
    out = e.join(placed, [*by, "event_id"], "left")
    resolution = (
        F.when(C("reason").isNotNull(), C("reason")).when(C("j_idx").isNull(), "no_price_match").when(~C("owns"), "same_day_suppressed")
        .when(sound, "factor").otherwise("base_inconsistent")
    )
    out = out.select(*by, "event_id", "nominal_idx", "j_idx", F.coalesce("basis", F.lit("unmatched")).alias("basis"), resolution.alias("resolution"), "r", "r_own", "s_own")
    taken = placed.where("owns").select(*by, "j_idx").distinct()
    free = found.join(taken, [*by, "j_idx"], "left_anti").where(C("change").isNotNull() | ~F.coalesce(C("quiet"), F.lit(False)))
    kind = F.when(C("change").isNull(), "unknown_price_only").when(sound, "unknown_base").otherwise("base_inconsistent")
    made = free.select(
        *by, F.lit(None).cast(dict(e.dtypes)["event_id"]).alias("event_id"), C("j_idx").cast(dict(e.dtypes)["nominal_idx"]).alias("nominal_idx"), "j_idx", F.lit("jump").alias("basis"),
        kind.alias("resolution"), "r", C("r").alias("r_own"), F.coalesce("change", 1 / C("r")).alias("s_own"),
    )
    out = out.unionByName(made)
    ok = C("resolution").isin("factor", "unknown_base")
    open_ = C("resolution").isin("base_inconsistent", "unknown_price_only")
    day = Window.partitionBy(*by, "j_idx")
    lead = F.row_number().over(day.orderBy(F.desc(open_), "event_id")) == 1
    settled = F.max(ok.cast("int")).over(day) == 1
    price_only = F.when(C("j_idx").isNotNull() & open_ & lead & ~settled, C("r"))
    return out.select(
        *by, "event_id", "nominal_idx", F.when(ok | open_, C("j_idx")).otherwise(C("nominal_idx")).alias("apply_idx"), "basis", "resolution", ok.alias("factor_ok"),
        F.when(ok, C("r_own")).otherwise(1.0).alias("price_factor"), F.when(ok, C("s_own")).otherwise(1.0).alias("share_factor"), price_only.alias("price_only_factor"),
    )
