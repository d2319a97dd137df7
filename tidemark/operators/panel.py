"""Research panels: what a model may see of each field on each session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward

C = F.col


@dataclass(frozen=True)
class GridField:
    """A column of the grid, seen so many sessions later; seen only within one listing."""

    name: str
    column: str
    lag: int = 1


@dataclass(frozen=True)
class FactField:
    """The last value (by, available_date, order, value) known at the close of the session so many before, by date, then order."""

    name: str
    rows: DataFrame
    value: str
    order: str
    lag: int = 1


def research_panel(grid: DataFrame, calendar: DataFrame, by: str, idx: str, span: str, fields: list[GridField], facts: list[FactField]) -> DataFrame:
    """(by, idx, span, a column for each field, and for each fact the date it was known): a row for each of the grid's.

    A grid field is the value of exactly lag sessions before if the security was listed without a break since; a session
    without a row, or one of another span, gives null. A fact is cut off at the session lag before, whatever the security:
    what became known after that session is not seen. calendar: (idx, d).
    """
    w = Window.partitionBy(by, span).orderBy(idx)
    at = lambda f: F.max(f.column).over(w.rangeBetween(-f.lag, -f.lag)) if f.lag else C(f.column)
    out = grid.select(by, idx, span, *[at(f).alias(f.name) for f in fields])
    lags = sorted({f.lag for f in facts})
    order = Window.orderBy(idx)  # a row a session
    cuts = calendar.select(idx, *[F.lag("d", n).over(order).alias(f"__c{n}") if n else C("d").alias("__c0") for n in lags])
    out = out.join(cuts, idx)
    for f in facts:
        # of several values that became known on one day the last by order
        known = f.rows.groupBy(by, C("available_date").alias("__d")).agg(F.max_by(f.value, f.order).alias(f.name))
        seen = asof_backward(out.withColumn("__d", C(f"__c{f.lag}")), known, [by], "__d", [f.name])
        # before the calendar has so many sessions there is no cut, and nothing is seen
        cut = C("__d").isNotNull()
        out = seen.withColumn(f.name, F.when(cut, C(f.name))).withColumn(f"{f.name}_known", F.when(cut, C("__d_matched"))).drop("__d", "__d_matched")
    return out.drop(*[f"__c{n}" for n in lags])
