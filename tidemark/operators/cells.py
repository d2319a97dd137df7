"""Daily grids whose cells say where their value is from, or why there is none.

What a cell may hold comes from several ledgers, and what was asked of each source from request windows. Ledgers, windows
(merged and written out by session) and the grid itself are rows of one key, so a grid of any number of sources is one
grouping, not a join for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


@dataclass(frozen=True)
class Source:
    """A ledger (by, at, order, columns): of several rows for a cell the first by order counts. windows: (by, status, lo, hi),
    status full or empty; full and empty name the evidence that they give."""

    name: str
    rows: DataFrame
    columns: list[str]
    order: list[str]
    windows: DataFrame | None = None
    full: str = "unit_ok"
    empty: str = "unit_empty"


def sessions_of(windows: DataFrame, by: str, at: str) -> DataFrame:
    """(by, at, prio) of the sessions that windows (by, status, lo, hi) cover: 2 if one of them is full, 1 if all are empty.

    Windows that overlap or meet are merged first, so a session asked for many times is written out once for each status.
    """
    w = Window.partitionBy(by, "status").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    d = windows.where("lo <= hi AND status IN ('full', 'empty')").withColumn("__new", F.when(C("lo") <= F.max("hi").over(w) + 1, 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = d.groupBy(by, "status", "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.select(by, F.explode(F.sequence("lo", "hi")).alias(at), F.when(C("status") == "full", 2).otherwise(1).alias("prio"))


def kind_of(has: Column, prio: Column, source: Source) -> Column:
    """{kind, evidence}: measured; src_omitted in a full window, empty_response in an empty one, else not_collected."""
    p = F.coalesce(prio, F.lit(0))
    kind = F.when(has, "measured").when(p == 2, "src_omitted").when(p == 1, "empty_response").otherwise("not_collected")
    return F.struct(kind.alias("kind"), F.when(p == 2, source.full).when(p == 1, source.empty).otherwise("none").alias("evidence"))


def filled_grid(grid: DataFrame, by: str, at: str, first: int, sources: list[Source]) -> DataFrame:
    """(by, at, columns of all sources, fill_<source>, reject_reason) for each cell of the grid (by, at) and each ledger row off it.

    reject_reason is null on the grid, pre_calendar before the session first, else off_grid.
    """
    rows = grid.select(by, at, F.lit(True).alias("__grid"))
    for s in sources:
        value, order = F.struct(*s.columns), F.struct(*[F.struct(C(o).isNull(), C(o)) for o in s.order])
        rows = rows.unionByName(s.rows.select(by, at, value.alias(f"__v_{s.name}"), order.alias(f"__o_{s.name}")), allowMissingColumns=True)
        if s.windows is not None:
            rows = rows.unionByName(sessions_of(s.windows, by, at).withColumnRenamed("prio", f"__p_{s.name}"), allowMissingColumns=True)
    aggregates = [F.max("__grid").alias("__grid")]
    for s in sources:
        aggregates += [F.min_by(f"__v_{s.name}", f"__o_{s.name}").alias(f"__v_{s.name}"), (F.count(f"__o_{s.name}") > 0).alias(f"__h_{s.name}")]
        if s.windows is not None:
            aggregates.append(F.max(f"__p_{s.name}").alias(f"__p_{s.name}"))
    g = rows.groupBy(by, at).agg(*aggregates)
    any_row = F.lit(False)
    for s in sources:
        any_row = any_row | C(f"__h_{s.name}")
    g = g.where(C("__grid").isNotNull() | any_row)
    reason = F.when(C("__grid").isNull(), F.when(C(at) < first, "pre_calendar").otherwise("off_grid"))
    fills = [kind_of(C(f"__h_{s.name}"), C(f"__p_{s.name}") if s.windows is not None else F.lit(0), s).alias(f"fill_{s.name}") for s in sources]
    return g.select(by, at, *[C(f"__v_{s.name}")[c].alias(c) for s in sources for c in s.columns], *fills, reason.alias("reject_reason"))


def balance_grid(grid: DataFrame, source: Source, shares: DataFrame, by: str, at: str, first: int, balances: list[str]) -> DataFrame:
    """(by, at, columns, fill, reject_reason): a grid of balances, with rejects beside it.

    A balance above the day's shares outstanding (shares: (by, at, shares)) is taken out: its cell is empty_response without
    values, the row stands beside it as balance_over_shares. Further versions of a cell are version_folded with their own
    values; rows off the grid off_grid or pre_calendar.
    """
    w = Window.partitionBy(by, at).orderBy(*[C(o).asc_nulls_last() for o in source.order])
    ver = source.rows.withColumn("__n", F.row_number().over(w)).join(shares.select(by, at, "shares"), [by, at], "left").join(grid.select(by, at, F.lit(True).alias("__on")), [by, at], "left")
    over = F.lit(False)
    for b in balances:
        over = over | F.coalesce(C(b) > C("shares"), F.lit(False))
    ver = ver.withColumn("__over", over & C("__on").isNotNull() & (C("__n") == 1))

    adopted = ver.where("__n = 1 AND __on").select(by, at, F.struct(*source.columns).alias("__v"), "__over")
    cells = grid.select(by, at, F.lit(True).alias("__grid")).unionByName(adopted, allowMissingColumns=True)
    cells = cells.unionByName(sessions_of(source.windows, by, at), allowMissingColumns=True)
    g = cells.groupBy(by, at).agg(F.max("__grid").alias("__grid"), F.first("__v", True).alias("__v"), F.max("__over").alias("__over"), F.max("prio").alias("prio")).where("__grid")
    dropped = F.coalesce("__over", F.lit(False))
    fill = kind_of(C("__v").isNotNull(), C("prio"), source)
    fill = F.struct(F.when(dropped, "empty_response").otherwise(fill["kind"]).alias("kind"), fill["evidence"].alias("evidence"))
    on = g.select(by, at, *[F.when(~dropped, C("__v")[c]).alias(c) for c in source.columns], fill.alias("fill"), F.lit(None).cast("string").alias("reject_reason"))
    reason = F.when(C("__n") > 1, "version_folded").when(C("__over"), "balance_over_shares").when(C("__on").isNull(), F.when(C(at) < first, "pre_calendar").otherwise("off_grid"))
    beside = ver.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL").join(sessions_of(source.windows, by, at).groupBy(by, at).agg(F.max("prio").alias("prio")), [by, at], "left")
    return on.unionByName(beside.select(by, at, *source.columns, kind_of(F.lit(True), C("prio"), source).alias("fill"), "reject_reason"))


def masked_balances(cells: DataFrame, bonuses: DataFrame, by: str, at: str, value: str, sessions: int) -> DataFrame:
    """cells with value masked, and bonus_window: for so many sessions from a bonus issue's first on, if it was known before.

    bonuses: (by, at, known). A masked measured cell says empty_response.
    """
    spans = bonuses.select(by, F.explode(F.sequence(C(at), C(at) + sessions - 1)).alias(at), "known").where(C("known") < C(at)).select(by, at).distinct()
    d = cells.join(spans.withColumn("bonus_window", F.lit(True)), [by, at], "left").withColumn("bonus_window", F.coalesce("bonus_window", F.lit(False)))
    kind = F.when(C("bonus_window") & (C("fill.kind") == "measured"), "empty_response").otherwise(C("fill.kind"))
    return d.withColumn("fill", F.struct(kind.alias("kind"), C("fill.evidence").alias("evidence"))).withColumn(value, F.when(~C("bonus_window"), C(value)))


def stacked_flows(grid: DataFrame, first_vendor: Source, second_vendor: Source, by: str, at: str, first: int) -> DataFrame:
    """(by, at, src, columns, fill, reject_reason): two vendors' rows one below the other, and a row for each cell without any.

    The second vendor lacks some columns, which are null there. A cell without a row names the vendor whose windows cover
    it, the first before the second, and what they say; rows off the grid are rejected.
    """
    both = [first_vendor, second_vendor]
    ledger = None
    for s in both:
        part = s.rows.select(by, at, F.lit(s.name).alias("src"), *s.columns)
        ledger = part if ledger is None else ledger.unionByName(part, allowMissingColumns=True)
    columns = [c for c in ledger.columns if c not in (by, at, "src")]
    cells = grid.select(by, at, F.lit(True).alias("__grid")).unionByName(ledger.select(by, at, F.struct("src", *columns).alias("__v")), allowMissingColumns=True)
    for s in both:
        cells = cells.unionByName(sessions_of(s.windows, by, at).withColumnRenamed("prio", f"__p_{s.name}"), allowMissingColumns=True)
    # the cell's rows come together, at most a few vendors' versions of one day
    g = cells.groupBy(by, at).agg(F.max("__grid").alias("__grid"), F.collect_list("__v").alias("rows"), *[F.max(f"__p_{s.name}").alias(f"__p_{s.name}") for s in both])
    g = g.where(C("__grid").isNotNull() | (F.size("rows") > 0))
    a, b = (kind_of(F.lit(False), C(f"__p_{s.name}"), s) for s in both)
    asked = F.when(C(f"__p_{both[0].name}").isNotNull(), a).otherwise(b)
    src = F.when(C(f"__p_{both[0].name}").isNotNull(), both[0].name).when(C(f"__p_{both[1].name}").isNotNull(), both[1].name)
    empty = F.array(F.struct(src.alias("src"), *[F.lit(None).cast(dict(ledger.dtypes)[c]).alias(c) for c in columns]))
    g = g.withColumn("__none", F.size("rows") == 0).withColumn("row", F.explode(F.when(C("__none"), empty).otherwise(C("rows"))))
    measured = F.struct(F.lit("measured").alias("kind"), F.lit("none").alias("evidence"))
    reason = F.when(C("__grid").isNull(), F.when(C(at) < first, "pre_calendar").otherwise("off_grid"))
    return g.select(by, at, "row.*", F.when(C("__none"), asked).otherwise(measured).alias("fill"), reason.alias("reject_reason"))
