"""What may be used when: publication cuts, eligibility, reasons for exclusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pit_cut(df: DataFrame, calendar: DataFrame, as_of, lag: int, available: str = "available_date") -> DataFrame:
    """Rows that were available by the session that lies lag sessions before the last one up to as_of."""
    at = calendar.where(F.col("d") <= F.lit(as_of)).agg(F.max("idx").alias("i"))
    cut = calendar.join(F.broadcast(at), F.col("idx") == F.col("i") - lag).select(F.col("d").alias("__cut"))
    return df.join(F.broadcast(cut), F.col(available) <= F.col("__cut")).drop("__cut")


def policy(predicates: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.expr(p), F.lit(False)) for p in predicates], F.lit(True))


def guard_future(c: Column, available: Column, as_of: Column) -> Column:
    return F.when(available <= as_of, c)


COMPARE = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
}


def eligibility_absolute(rules: list[tuple[str, str, float]]) -> Column:
    """Reasons why a row is out, in the order of the rules: field_missing or field_op; empty if it is in."""
    one = lambda f, op, v: F.when(F.col(f).isNull(), F.lit(f"{f}_missing")).when(~COMPARE[op](F.col(f), F.lit(v)), F.lit(f"{f}_{op}"))
    return F.array_compact(F.array(*[one(*r) for r in rules]))


def eligibility_top(df: DataFrame, keys: list[str], field: str, id_: str, percent: float | None = None, count: int | None = None, name: str = "in_top") -> DataFrame:
    """Marks the first percent or count of the rows that have a value, by falling value, then id."""
    w = Window.partitionBy(*keys, F.col(field).isNull())
    place = F.row_number().over(w.orderBy(F.col(field).desc(), id_))
    most = F.lit(count) if percent is None else F.floor(F.count("*").over(w) * percent + 1e-9)
    return df.withColumn(name, F.col(field).isNotNull() & (place <= most))


def grid_reject(df: DataFrame, grid: DataFrame, keys: list[str], calendar: DataFrame, day: str) -> DataFrame:
    """Rows with a reject_reason: pre_calendar, off_calendar, off_grid or null."""
    cal = calendar.select(F.col("d").alias(day), F.lit(True).alias("__c"))
    first = calendar.agg(F.min("d").alias("__first"))
    g = grid.select(*keys, F.lit(True).alias("__g")).distinct()
    j = df.join(F.broadcast(first)).join(F.broadcast(cal), day, "left").join(g, keys, "left")
    reason = F.when(F.col(day) < F.col("__first"), "pre_calendar").when(F.col("__c").isNull(), "off_calendar").when(F.col("__g").isNull(), "off_grid")
    return j.select(*df.columns, reason.alias("reject_reason"))


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that does not hold; null if all do."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def selection_funnel(df: DataFrame, reasons: str) -> DataFrame:
    """Rows by reason; those without one count as eligible."""
    return df.select(F.explode(F.when(F.size(reasons) > 0, F.col(reasons)).otherwise(F.array(F.lit("eligible")))).alias("reason")).groupBy("reason").count()
