"""Joins in time: as-of, ranges, event windows, best matches; and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], forward: bool, strict: bool) -> DataFrame:
    """Both sides in one order, so each is sorted once and no pair of rows is made; at equal times the tag decides."""
    lc = [c for c in left.columns if c not in [*by, on]]
    # of rows at the same time the right side goes first if it may match, last if not (backwards: the other way round)
    tag = 1 if strict != forward else 0
    nothing = lambda df, names, kinds: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
    lt = dict(left.dtypes)
    r = right.select(*by, on, F.lit(tag).alias("__tag"), F.struct(F.col(on).alias("__at"), *values).alias("__r"), *nothing(left, lc, lt))
    kind = dict(r.dtypes)["__r"]
    lft = left.select(*by, on, F.lit(1 - tag).alias("__tag"), F.lit(None).cast(kind).alias("__r"), *lc)
    w = Window.partitionBy(*by).orderBy(on, "__tag")
    found = F.first("__r", True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("__r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = lft.unionByName(r).withColumn("__f", found).where(F.col("__tag") == 1 - tag)
    return out.select(*by, on, *lc, F.col("__f.__at").alias(f"{on}_matched"), *[F.col(f"__f.{v}").alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the last right row at or before its time (strict: before)."""
    return _asof(left, right, by, on, values, False, strict)


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the first right row at or after its time."""
    return _asof(left, right, by, on, values, True, False)


def scheduled(df: DataFrame, at: str, schedule: DataFrame, values: list[str], forward: bool = False) -> DataFrame:
    """df with the values of the schedule's (d, values) last entry on or before the date at (forward: the first on or after).

    For schedules without a key of their own, such as rates or calendars. An entry a day at most. Dates meet the entries of
    their month and the one carried into it by equality on the month, so rows stay where they are and no task holds all.
    """
    lo, hi = schedule.agg(F.add_months(F.trunc(F.min("d"), "month"), -1), F.add_months(F.trunc(F.max("d"), "month"), 1)).first()
    if lo is None:
        return df.withColumns({v: F.lit(None).cast(dict(schedule.dtypes)[v]) for v in values})
    month = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.trunc(c, "month"))).alias("__m")
    entry = F.struct("d", *values)
    own = schedule.select(month(F.col("d")), entry.alias("e")).groupBy("__m").agg(F.array_sort(F.collect_list("e")).alias("own"))
    months = schedule.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date'{lo}', date'{hi}', interval 1 month)")).alias("__m")).join(own, "__m", "left")
    w = Window.orderBy("__m")  # a row a month
    rest = w.rowsBetween(1, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, -1)
    near = F.get("own", F.lit(0)) if forward else F.try_element_at("own", F.lit(-1))
    carried = (F.first if forward else F.last)(near, True).over(rest)
    there = F.coalesce("own", F.array().cast(dict(own.dtypes)["own"]))
    months = months.withColumn("c", F.array_compact(F.array(carried))).select("__m", (F.concat(there, "c") if forward else F.concat("c", there)).alias("__e"))
    d = df.withColumn("__m", month(F.col(at))).join(months, "__m", "left")
    fits = F.filter("__e", lambda e: e["d"] >= F.col(at) if forward else e["d"] <= F.col(at))
    found = F.get(fits, F.lit(0)) if forward else F.try_element_at(fits, F.lit(-1))
    d = d.withColumn("__f", found)
    return d.select(*df.columns, *[F.col(f"__f.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Points inside ranges, both by integer session: ranges are spread over their sessions, then joined by equality."""
    spread = ranges.where(F.col(lo) <= F.col(hi)).withColumn(at, F.explode(F.sequence(lo, hi)))
    return points.join(spread, [*by, at])


def expand_event_window(events: DataFrame, by: list[str], idx: str, before: int, after: int) -> DataFrame:
    """The sessions from before ahead of an event to after behind it, once each: (by, idx)."""
    return events.select(*by, F.explode(F.sequence(F.col(idx) - before, F.col(idx) + after)).alias(idx)).distinct()


def match_best(units: DataFrame, seen: DataFrame, by: list[str], at: str, value: str, window: int, tolerance: float) -> DataFrame:
    """Pairs within window sessions and a relative tolerance that are best for both sides.

    Sessions are put in cells of the window's width and only neighbouring cells are joined. Better is nearer in value,
    then in time, then earlier.
    """
    cell = (F.floor(F.col(at) / window)).alias("__cell")
    u = units.select(*by, F.col(at).alias("u_at"), F.col(value).alias("u_value"), F.explode(F.sequence(F.floor(F.col(at) / window) - 1, F.floor(F.col(at) / window) + 1)).alias("__cell"))
    s = seen.select(*by, F.col(at).alias("s_at"), F.col(value).alias("s_value"), cell)
    gap = F.abs(F.col("s_value") / F.col("u_value") - 1)
    j = u.join(s, [*by, "__cell"]).withColumn("gap", gap).where((F.abs(F.col("u_at") - F.col("s_at")) <= window) & (F.col("gap") <= tolerance))
    near = [F.col("gap"), F.abs(F.col("u_at") - F.col("s_at"))]
    ru = F.row_number().over(Window.partitionBy(*by, "u_at").orderBy(*near, "s_at"))
    rs = F.row_number().over(Window.partitionBy(*by, "s_at").orderBy(*near, "u_at"))
    return j.withColumn("ru", ru).withColumn("rs", rs).where("ru = 1 AND rs = 1").select(*by, "u_at", "s_at", "u_value", "s_value")


def suppress_near_dups(events: DataFrame, by: list[str], day: str, rank: str, days: int) -> DataFrame:
    """Events without those that one of a better (lower) rank has within so many days: one window, no pairs."""
    w = Window.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(-days, days)
    d = events.withColumn("__best", F.min(rank).over(w))
    return d.where(F.col("__best").isNull() | F.col(rank).isNull() | (F.col("__best") >= F.col(rank))).drop("__best")


def diff_builds(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row of counts: rows added, removed, common, and for each column changed, lost and gained values."""
    b = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("b_in"))
    a = after.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("a_in"))
    j = b.join(a, [F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}")) for k in keys], "full_outer")
    both = F.col("b_in") & F.col("a_in")
    out = [F.count_if(F.col("b_in").isNull()).alias("added"), F.count_if(F.col("a_in").isNull()).alias("removed"), F.count_if(both).alias("common")]
    for c in columns:
        x, y = F.col(f"b_{c}"), F.col(f"a_{c}")
        far = F.abs(x - y) > tolerance * F.greatest(F.abs(x), F.abs(y))
        out += [F.count_if(both & far).alias(f"{c}_changed"), F.count_if(both & x.isNotNull() & y.isNull()).alias(f"{c}_lost"), F.count_if(both & x.isNull() & y.isNotNull()).alias(f"{c}_gained")]
    return j.agg(*out)


def previous_opinion(df: DataFrame, by: list[str], day: str, known: str, value: str) -> DataFrame:
    """The value of the latest earlier record that was known by a record's day, and when it was known.

    A record can be found from the day after its own on, once it is known. In the order of that time, each record takes the
    best of those that entered before it: a running maximum, whatever the length of a history.
    """
    entry = F.struct(F.col(day).alias("d"), F.col(known).alias("k"), F.col(value).alias("v"))
    rows = df.select("*", F.col(day).alias("__at"), F.lit(1).alias("__asks"), F.lit(None).cast(df.select(entry.alias("e")).schema["e"].dataType).alias("__e"))
    come = df.where(F.col(known).isNotNull() & F.col(day).isNotNull())
    come = come.select("*", F.greatest(F.col(known), F.date_add(day, 1)).alias("__at"), F.lit(0).alias("__asks"), entry.alias("__e"))
    w = Window.partitionBy(*by).orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = rows.unionByName(come).withColumn("__p", F.max("__e").over(w))
    return d.where("__asks = 1").select(*df.columns, F.col("__p.v").alias("prev_value"), F.col("__p.k").alias("prev_known"))


def link_corrections(df: DataFrame, by: list[str], filed: str, id_: str, correction: Column) -> DataFrame:
    """Each correction with the latest original of its group filed before it, and how many there were."""
    d = df.withColumn("__c", correction)
    w = Window.partitionBy(*by).orderBy(filed, id_).rowsBetween(Window.unboundedPreceding, -1)
    original = F.when(~F.col("__c"), F.col(id_))
    d = d.withColumn("original", F.last(original, True).over(w)).withColumn("candidates", F.count(original).over(w))
    return d.where("__c").drop("__c")


def event_components(df: DataFrame, by: list[str], idx: str, gap: int) -> DataFrame:
    """Chains of events at most gap sessions apart: component number and size."""
    w = Window.partitionBy(*by).orderBy(idx)
    new = F.when(F.col(idx) - F.lag(idx).over(w) <= gap, 0).otherwise(1)
    d = df.withColumn("__n", new).withColumn("component", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")
    return d.withColumn("size", F.count("*").over(Window.partitionBy(*by, "component")))
