"""Columns that turn untyped text into values, and say why where they can't."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NumberRule:
    """sign: abs, strip (a leading + goes) or keep; scale multiplies before the cast; zero may stand for missing."""

    precision: int = 18
    digits: int = 4
    sign: str = "keep"
    scale: str = "1"
    zero_missing: bool = False
    lo: float | None = None
    hi: float | None = None


def _cleaned(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, ",", ""))


def cast_numeric(c: Column, rule: NumberRule = NumberRule()) -> Column:
    x = _cleaned(c)
    if rule.sign in ("strip", "abs"):
        x = F.regexp_replace(x, r"^\+", "")
    kind = f"decimal({rule.precision},{rule.digits})"
    n = x.try_cast(kind)
    if rule.sign == "abs":
        n = F.abs(n)
    n = (n * F.lit(rule.scale).cast("decimal(18,6)")).try_cast(kind)
    if rule.zero_missing:
        n = F.nullif(n, F.lit(0).cast(kind))
    if rule.lo is not None:
        n = F.when(n >= rule.lo, n)
    return n if rule.hi is None else F.when(n <= rule.hi, n)


FORMATS = {"iso": "yyyy-MM-dd", "compact": "yyyyMMdd", "dotted": "yyyy.MM.dd", "slashed": "yyyy/MM/dd", "month": "yyyy-MM", "korean": "yyyy년 MM월 dd일"}


def cast_date(c: Column, form: str, lo: int = 1950, hi: int = 2100) -> Column:
    """A date in one of the named formats; other text and years outside lo..hi give null."""
    d = F.try_to_date(F.trim(c), FORMATS[form])
    return F.when(F.year(d).between(lo, hi), d)


def miss_kind(c: Column, rule: NumberRule = NumberRule()) -> Column:
    """Why a cell has no number: ledger_null, blank, dash, zero, out_of_range or cast_failed; null if it has one."""
    x = _cleaned(c)
    plain = NumberRule(rule.precision, rule.digits, rule.sign, rule.scale)
    n = cast_numeric(c, plain)
    out = F.when(c.isNull(), "ledger_null").when(x == "", "blank").when(x.isin("-", "--"), "dash").when(n.isNull(), "cast_failed")
    if rule.zero_missing:
        out = out.when(n == 0, "zero")
    return out.when(cast_numeric(c, rule).isNull(), "out_of_range")


def observed_date(c: Column, hours: int = 9) -> Column:
    """The local day of a time stamp in UTC."""
    return (F.try_to_timestamp(c) + F.make_interval(hours=F.lit(hours))).cast("date")


def yoy(now: Column, before: Column) -> tuple[Column, Column]:
    """Growth over the year before where that was positive, and a word for a changed sign."""
    word = F.when((before < 0) & (now >= 0), "to_profit").when((before >= 0) & (now < 0), "to_loss").when((before < 0) & (now < 0), "still_loss")
    return F.when(before > 0, now / before - 1), word


def classify(rules: list[tuple[str, Column]], other: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(other).cast("string")
    for name, on in reversed(rules):
        out = F.when(on, F.lit(name)).otherwise(out)
    return out


def to_unit(c: Column, from_: str, to: str) -> Column:
    # Won in each unit.
    won = {"won": 1.0, "thousand": 1e3, "million": 1e6, "100m": 1e8}
    return c * F.lit(won[from_] / won[to])
