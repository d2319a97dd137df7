"""Stock models: indicators, scores, gates, comparison of two score sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks

from .aggregates import weighted_available

C = F.col


def price_indicators(df: DataFrame, by: list[str], order: str, price: str, ok: Column, short: int = 60, month: int = 21, year: int = 252) -> DataFrame:
    """vol, r1m, r3m, r6m, mom (12-1) and high_ratio; null where the window is not full or crosses an unresolved event."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__ok", ok.cast("int")).withColumn("__r", F.try_divide(C(price), F.lag(price).over(w)) - 1)
    back = lambda n: w.rowsBetween(-(n - 1), 0)
    clean = lambda n: F.min("__ok").over(back(n)) == F.max("__ok").over(back(n))
    ret = lambda n: F.when(clean(n + 1), F.try_divide(C(price), F.lag(price, n).over(w)) - 1)
    return d.select(
        *by, order,
        F.when(clean(short) & (F.count("__r").over(back(short)) >= math.ceil(short * 0.75)), F.stddev_samp("__r").over(back(short)) * math.sqrt(252)).alias("vol"),
        ret(month).alias("r1m"), ret(3 * month).alias("r3m"), ret(6 * month).alias("r6m"),
        F.when(clean(year + 1), F.try_divide(F.lag(price, month).over(w), F.lag(price, year).over(w)) - 1).alias("mom"),
        F.when(clean(year) & (F.count(price).over(back(year)) >= math.ceil(year * 0.8)), F.try_divide(C(price), F.max(price).over(back(year)))).alias("high_ratio"),
    )


def pullback(df: DataFrame, keys: list[str], strong: str, weak: str) -> Column:
    """Mean of the percent ranks of strength and of recent weakness, among rows that have both."""
    both = C(strong).isNotNull() & C(weak).isNotNull()
    a, b = F.when(both, C(strong)), F.when(both, -C(weak))
    return (ranks.pct_rank_min(keys, a) + ranks.pct_rank_min(keys, b)) / 2


def revisions(df: DataFrame, now: str, before: str, analysts: str, least: int) -> tuple[Column, Column]:
    """Change of an estimate against its old absolute value, and whether its sign changed; null with too few analysts."""
    on = (C(analysts) >= least) & (C(before) != 0)
    return F.when(on, (C(now) - C(before)) / F.abs(before)), F.when(on, F.signum(now) != F.signum(before))


def score_rank_model(df: DataFrame, keys: list[str], spec: dict[str, dict], group: str | None = None, min_group: int = 5, max_missing: float = 0.5) -> DataFrame:
    """Percentiles 0..100 of each indicator by its direction, bucket means, and the weighted score of the buckets.

    spec: bucket -> {weight, items: {column: 1 or -1}, neutral: whether ranked inside the group}. A bucket with more than
    max_missing of its items missing is missing.
    """
    d = df
    for b, s in spec.items():
        for c, sign in s["items"].items():
            x = C(c) * sign
            d = d.withColumn(f"__p_{b}_{c}", ranks.group_rank(keys, group, x, min_group) if group and s.get("neutral") else ranks.pct_rank_100(keys, x))
        names = [f"__p_{b}_{c}" for c in s["items"]]
        missing = sum((C(n).isNull().cast("int") for n in names), F.lit(0)) / len(names)
        d = d.withColumn(f"bucket_{b}", F.when(missing <= max_missing, weighted_available(dict.fromkeys(names, 1.0))))
    d = d.withColumn("score", weighted_available({f"bucket_{b}": s["weight"] for b, s in spec.items()}))
    return d.drop(*[c for c in d.columns if c.startswith("__p_")])


def apply_gates(df: DataFrame, keys: list[str], gates: list[tuple[str, str, float]]) -> Column:
    """The first gate that shuts a row out: (column, bottom or top, percent) or (column, required, 0)."""
    out = F.lit(None).cast("string")
    for c, kind, q in reversed(gates):
        p = ranks.pct_rank_100(keys, C(c))
        on = C(c).isNull() if kind == "required" else F.coalesce(p < q if kind == "bottom" else p > 100 - q, F.lit(False))
        out = F.when(on, F.lit(f"{c}_{kind}")).otherwise(out)
    return out


def score_z_model(df: DataFrame, keys: list[str], items: dict[str, tuple[float, int]], limit: float = 3.0) -> DataFrame:
    """Weighted mean of winsorised z scores that are there. items: column -> (weight, direction)."""
    d = df
    for c, (_, sign) in items.items():
        d = d.withColumn(f"z_{c}", ranks.zscore_winsor(keys, C(c) * sign, limit))
    return d.withColumn("score", weighted_available({f"z_{c}": w for c, (w, _) in items.items()}))


def score_percentrank_model(df: DataFrame, keys: list[str], items: dict[str, tuple[float, bool]]) -> DataFrame:
    """Weighted sum of percent ranks; a missing one counts 0, an inverted one is one minus its rank."""
    d, total = df, F.lit(0.0)
    for c, (w, inverted) in items.items():
        p = ranks.percentrank_inc(keys, C(c).cast("double"))
        d = d.withColumn(f"p_{c}", F.coalesce(1 - p if inverted else p, F.lit(0.0)))
        total = total + C(f"p_{c}") * w
    return d.withColumn("score", total)


def compare_scores(a: DataFrame, b: DataFrame, keys: list[str], id_: str, n: int) -> DataFrame:
    """(keys, common, spearman, overlap): rank correlation and shared top n on the rows both have."""
    j = a.select(*keys, id_, C("score").alias("__a")).join(b.select(*keys, id_, C("score").alias("__b")), [*keys, id_])
    w = Window.partitionBy(*keys)
    j = j.select(*keys, ranks.average_rank(keys, C("__a")).alias("ra"), ranks.average_rank(keys, C("__b")).alias("rb"), F.row_number().over(w.orderBy(F.desc("__a"), id_)).alias("ta"), F.row_number().over(w.orderBy(F.desc("__b"), id_)).alias("tb"))
    return j.groupBy(*keys).agg(F.count("*").alias("common"), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("spearman"), F.count_if((C("ta") <= n) & (C("tb") <= n)).alias("overlap"))


def rank_trend(df: DataFrame, id_: str, idx: str, rank: str, steps: dict[str, int]) -> DataFrame:
    """Change of rank against earlier sessions; up is positive."""
    d = df
    for name, k in steps.items():
        before = df.select(id_, (C(idx) + k).alias(idx), C(rank).alias(f"__{name}"))
        d = d.join(before, [id_, idx], "left").withColumn(name, C(f"__{name}") - C(rank)).drop(f"__{name}")
    return d


def list_moves(df: DataFrame, id_: str, idx: str, rank: str, n: int) -> DataFrame:
    """Names that enter or leave the first n from one session to the next."""
    top = df.where(C(rank) <= n).select(id_, idx)
    now, before = top.withColumn("__n", F.lit(1)), top.select(id_, (C(idx) + 1).alias(idx), F.lit(1).alias("__b"))
    last = df.agg(F.max(idx).alias("__last"), F.min(idx).alias("__first"))
    j = now.join(before, [id_, idx], "full_outer").join(F.broadcast(last)).where((C(idx) <= C("__last")) & (C(idx) > C("__first")))
    return j.where("__n IS NULL OR __b IS NULL").select(id_, idx, F.when(C("__b").isNull(), "in").otherwise("out").alias("move"))


def excess_z(df: DataFrame, by: list[str], order: str, ret: str, index: str, n: int) -> DataFrame:
    """The last excess return over the deviation of the n before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-n, -1)
    d = df.withColumn("__x", C(ret) - C(index))
    return d.withColumn("z", F.when(F.count("__x").over(w) >= n // 2, F.try_divide(C("__x"), F.stddev_samp("__x").over(w)))).drop("__x")
