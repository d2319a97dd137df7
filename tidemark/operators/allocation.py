"""Weights under caps on names and sectors, gross and net targets and sector neutrality, without rounds.

A budget over names with scores s and caps c is shared as min(c, k s) with one k. In order of c / s the capped names come
first, so k follows from two running sums: a sort, no iteration. Caps on sectors nest: a sector that would pass its cap
gets its own k, which lowers the caps of its names; with those the side is shared once more, and no cap is broken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


@dataclass(frozen=True)
class Limits:
    gross: float = 1.0
    net: float = 1.0
    name: float = 0.1
    sector: float = 0.3
    neutral: bool = False

    def __post_init__(self):
        if abs(self.net) > self.gross:
            raise ValueError(f"net {self.net} is beyond gross {self.gross}")
        if self.neutral and self.net:
            raise ValueError("sectors can only be neutral at a net of 0")

    def budget(self) -> Column:
        """Of a row's side."""
        return F.when(C("side") == "long", (self.gross + self.net) / 2).otherwise((self.gross - self.net) / 2)


def share(df: DataFrame, keys: list[str], score: str, cap: str, budget: Column, order: list[str], out: str) -> DataFrame:
    """df with out: the row's part min(cap, k score) of its group's budget, k the same in a group; all at cap if that is less.

    Rows with a score of 0 or less, or without one, get 0.
    """
    s = F.when(C(score) > 0, C(score).cast("double")).otherwise(0.0)
    d = df.withColumn("__s", s).withColumn("__c", F.when(C("__s") > 0, C(cap).cast("double")).otherwise(0.0)).withColumn("__b", budget.cast("double"))
    w = Window.partitionBy(*keys).orderBy(F.try_divide("__c", "__s").asc_nulls_first(), *order)
    capped = F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # a frame up to the end would be summed anew for each row, so the sum of what follows runs in the opposite order
    back = Window.partitionBy(*keys).orderBy(F.try_divide("__c", "__s").desc_nulls_last(), *[F.desc(c) for c in order])
    left = F.sum("__s").over(back.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__k", F.try_divide(C("__b") - capped, left))
    # a name is free if its group's k, were all before it capped, leaves it below its cap
    free = (C("__s") > 0) & (C("__k") * C("__s") < C("__c"))
    k = F.max(F.when(free, F.greatest("__k", F.lit(0.0)))).over(Window.partitionBy(*keys))
    d = d.withColumn("__all", k)
    return d.withColumn(out, F.least("__c", F.coalesce(C("__all") * C("__s"), C("__c")))).drop("__s", "__c", "__b", "__k", "__all")


def nested_weights(df: DataFrame, keys: list[str], name: str, sector: str, score: str, limits: Limits) -> DataFrame:
    """df (with side, long or short) with weight: signed, within every cap, and unspent, what a side's caps leave over.

    With neutral, every sector's long and short weights cancel: sectors share each side's budget by their scores, as far as
    both their sides can hold it.
    """
    side, part = [*keys, "side"], [*keys, "side", sector]
    d = df.repartition(*keys).withColumn("__name", F.lit(limits.name))
    # the names' caps, lowered where the sector's cap binds
    d = share(d, part, score, "__name", F.lit(limits.sector), [name], "__cap")
    if limits.neutral:
        room = d.groupBy(*part).agg(F.sum("__cap").alias("__room"), F.sum(F.greatest(C(score), F.lit(0.0))).alias("__score"))
        room = room.groupBy(*keys, sector).agg(F.count("*").alias("__sides"), F.min("__room").alias("__room"), F.sum("__score").alias("__score"))
        room = room.withColumn("__room", F.when(C("__sides") == 2, C("__room")).otherwise(0.0))
        room = share(room, keys, "__score", "__room", F.lit(limits.gross / 2), [sector], "__budget")
        d = d.join(room.select(*keys, sector, "__budget"), [*keys, sector])
        d = share(d, part, score, "__cap", C("__budget"), [name], "__w").drop("__budget")
    else:
        d = share(d, side, score, "__cap", limits.budget(), [name], "__w")
    left = limits.budget() - F.sum("__w").over(Window.partitionBy(*side))
    sign = F.when(C("side") == "long", 1.0).otherwise(-1.0)
    return d.withColumn("unspent", F.greatest(left, F.lit(0.0))).withColumn("weight", sign * C("__w")).drop("__w", "__cap", "__name")


def violations(weights: DataFrame, keys: list[str], sector: str, limits: Limits, slack: float = 1e-9) -> DataFrame:
    """(keys, names, sectors, sides, neutral): how many limits of each kind a portfolio breaks."""
    size = F.abs("weight")
    s = weights.groupBy(*keys, "side", sector).agg(F.count_if(size > limits.name + slack).alias("__n"), F.sum(size).alias("__t"), F.max(limits.budget()).alias("__b"))
    s = s.withColumn("__net", F.sum(F.when(C("side") == "long", C("__t")).otherwise(-C("__t"))).over(Window.partitionBy(*keys, sector)))
    s = s.withColumn("__side", F.sum("__t").over(Window.partitionBy(*keys, "side")))
    return s.groupBy(*keys).agg(
        F.sum("__n").alias("names"), F.count_if(C("__t") > limits.sector + slack).alias("sectors"), F.count_if(C("__side") > C("__b") + slack).alias("sides"),
        F.count_if((F.abs("__net") > slack) & F.lit(limits.neutral)).alias("neutral"),
    )
