"""Loss scenarios of portfolios, verdicts on grids of trials, estimate revisions by horizon, changes of row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .walkforward import neighbor_scores

C = F.col


# ---- scenarios


def scenarios(weights: DataFrame, closes: DataFrame, index: DataFrame, betas: DataFrame, windows: list[tuple[str, str, str]], book: str, symbol: str, gap: float = -0.3, circuit: float = -0.2) -> DataFrame:
    """(book, scenario, portfolio, index, lines, proxies, missing): what each portfolio would lose.

    For each window (name, first day, last day) a name's return is that of its closes on the two days, else its beta times
    the index's; names with neither are missing and count as 0. A close of 0 on the last day is a return of -1; on the first
    it is no close. gap: the heaviest name (of equal ones the last) falls by
    that much. circuit: the index falls by that much and each name by its beta times it, no further than gap. weights:
    (book, symbol, weight); closes: (symbol, d, close); index: (d, close); betas: (symbol, beta).
    """
    spark = weights.sparkSession
    days = spark.createDataFrame([(n, at, day) for n, *pair in windows for at, day in zip(("first", "last"), pair, strict=True)], "scenario string, at string, d string").withColumn("d", C("d").cast("date"))
    ends = lambda d, keys: d.join(F.broadcast(days), "d").groupBy(*keys, "scenario").agg(F.max(F.when(C("at") == "first", C("close"))).alias("c0"), F.max(F.when(C("at") == "last", C("close"))).alias("c1"))
    own = ends(closes, [symbol]).select(symbol, "scenario", (F.try_divide("c1", "c0") - 1).alias("own"))
    market = ends(index, []).select("scenario", (F.try_divide("c1", "c0") - 1).alias("market"))
    w = weights.join(betas, symbol, "left")
    names = F.explode(F.array(*[F.lit(n) for n, *_ in windows])).alias("scenario")
    h = w.select(book, symbol, "weight", "beta", names).join(own, [symbol, "scenario"], "left").join(F.broadcast(market), "scenario", "left")
    h = h.withColumn("ret", F.coalesce("own", C("beta") * C("market"))).withColumn("proxy", C("own").isNull() & C("ret").isNotNull())
    fall = F.when(C("beta").isNotNull(), F.greatest(F.lit(gap), C("beta") * circuit))  # greatest passes over nulls
    c = w.select(book, symbol, "weight", F.lit("circuit").alias("scenario"), F.lit(circuit).alias("market"), fall.alias("ret"), F.lit(False).alias("proxy"))
    heaviest = w.groupBy(book).agg(F.max(F.struct("weight", symbol)).alias("m"))
    g = heaviest.select(book, F.col(f"m.{symbol}").alias(symbol), C("m.weight").alias("weight"), F.lit("gap").alias("scenario"), F.lit(None).cast("double").alias("market"), F.lit(gap).alias("ret"), F.lit(False).alias("proxy"))
    columns = [book, symbol, "weight", "scenario", "market", "ret", "proxy"]
    lines = h.select(columns).unionByName(c.select(columns)).unionByName(g.select(columns))
    return lines.groupBy(book, "scenario").agg(
        F.sum(F.coalesce(C("weight") * C("ret"), F.lit(0.0))).alias("portfolio"), F.max("market").alias("index"), F.count("ret").alias("lines"), F.count_if("proxy").alias("proxies"),
        F.array_sort(F.collect_list(F.when(C("ret").isNull(), C(symbol)))).alias("missing"),
    )


# ---- grids of trials

PEAK_RATIO, SENSITIVITY = 0.5, 0.2


def outcomes(trials: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """(by, axes, outcome, score): of each cell's windows (status, bankrupt, score). bankrupt if any failed so, failed if any
    failed, scored with the mean if all are completed with a score, else open."""
    t = F.coalesce(C("status") == "failed", F.lit(False))
    done = F.coalesce((C("status") == "completed") & C("score").isNotNull(), F.lit(False))
    g = trials.groupBy(*by, *axes).agg(F.max(t & C("bankrupt")).alias("__b"), F.max(t).alias("__f"), F.min(done).alias("__d"), F.avg("score").alias("__s"))
    outcome = F.when(C("__b"), "bankrupt").when(C("__f"), "failed").when(C("__d"), "scored").otherwise("open")
    return g.select(*by, *axes, outcome.alias("outcome"), F.when(outcome == "scored", C("__s")).alias("score"))


def moves(values: dict[str, list[float]]) -> list[tuple[str, int, int, int]]:
    """(axis, from, to, order): for each value of each axis the nearest other value to a fifth less and a fifth more, on that side."""
    out = []
    for axis, numbers in values.items():
        for i, v in enumerate(numbers):
            for n, target in enumerate((v * (1 - SENSITIVITY), v * (1 + SENSITIVITY))):
                side = [j for j, x in enumerate(numbers) if (x < v if target < v else x > v)] if target != v else []
                if side:
                    out.append((axis, i, min(side, key=lambda j: (abs(numbers[j] - target), abs(j - i))), n))
    return out


def plateau_verdicts(cells: DataFrame, by: list[str], values: dict[str, list[float]]) -> DataFrame:
    """(by, axes, score, neighbor_mean, verdict, sensitivity, moved) of each cell, from outcomes; values: each axis' numbers, by
    which axes are positions.

    Bankrupt cells count with the worst score, 0 at most, as neighbours. recommended: the best neighbour mean of cells with a
    score and mean above 0, of equal ones the first; cells without neighbours only if all are so. peak: a best score above
    0 whose neighbours' mean is under PEAK_RATIO of it. sensitivity: the largest share of a score above 0 that is lost by
    moving one axis to the value next to a fifth less or more; moved says where, as axis:position.
    """
    axes = list(values)
    group = Window.partitionBy(*by)
    c = cells.withColumn("__floor", F.least(F.min("score").over(group), F.lit(0.0)))
    filled = c.where("outcome IN ('scored', 'bankrupt')").select(*by, *axes, F.coalesce("score", "__floor", F.lit(0.0)).alias("score"))
    means = neighbor_scores(filled, by, axes)
    alone = filled.select(*by, *axes, C("score").alias("__f"))
    # a cell has neighbours if its value isn't its own for want of any
    near = _has_neighbors(filled, by, axes)
    s = c.where("outcome = 'scored'").join(means.select(*by, *axes, C("value").alias("rank")), [*by, *axes]).join(near, [*by, *axes], "left")
    s = s.withColumn("neighbor_mean", F.when(C("__near"), C("rank")))
    any_near = F.max(F.coalesce("__near", F.lit(False))).over(group)
    able = (C("score") > 0) & (C("rank") > 0) & (F.coalesce("__near", F.lit(False)) | ~any_near)
    s = s.withColumn("__able", able).withColumn("__top", F.max("score").over(group))
    best = F.row_number().over(Window.partitionBy(*by, "__able").orderBy(F.desc("rank"), *axes))
    s = s.withColumn("__best", C("__able") & (best == 1))
    peak = (C("score") == C("__top")) & (C("score") > 0) & (C("rank") < PEAK_RATIO * C("score"))
    s = s.withColumn("verdict", F.when(C("__best"), "recommended").when(peak, "peak").otherwise("scored"))
    step = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k * 2 + n).alias("order")) for k, a in enumerate(axes) for x, i, j, n in moves({a: values[a]}) if x == a])
    position = F.coalesce(*[F.when(C("m.axis") == a, C(a)) for a in axes])
    m = s.where("score > 0").select(*by, *axes, C("score").alias("__s"), F.explode(step).alias("m")).where(position == C("m.i"))
    m = m.select(*by, *[C(a).alias(f"__{a}") for a in axes], "__s", "m", *[F.when(C("m.axis") == a, C("m.j")).otherwise(C(a)).cast(dict(cells.dtypes)[a]).alias(a) for a in axes])
    m = m.join(alone, [*by, *axes]).withColumn("drop", (C("__s") - C("__f")) / C("__s"))
    worst = m.groupBy(*by, *[f"__{a}" for a in axes]).agg(F.max_by(F.struct("drop", F.concat_ws(":", "m.axis", "m.j").alias("moved")), F.struct("drop", -C("m.order"))).alias("w"))
    worst = worst.select(*by, *[C(f"__{a}").alias(a) for a in axes], C("w.drop").alias("sensitivity"), "w.moved")
    out = s.select(*by, *axes, "score", "neighbor_mean", "verdict").join(worst, [*by, *axes], "left")
    rest = c.where("outcome <> 'scored'").select(*by, *axes, F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("neighbor_mean"), F.when(C("outcome") == "open", "unscored").otherwise("failed").alias("verdict"), F.lit(None).cast("double").alias("sensitivity"), F.lit(None).cast("string").alias("moved"))
    return out.unionByName(rest)


def _has_neighbors(cells: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """(by, axes, __near) of the places next to a cell."""
    d = cells.select(*by, *axes)
    for a in axes:
        d = d.withColumn(f"__{a}", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    moved = F.lit(False)
    for a in axes:
        moved = moved | (C(f"__{a}") != 0)
    return d.where(moved).select(*by, *[(C(a) + C(f"__{a}")).cast(dict(cells.dtypes)[a]).alias(a) for a in axes]).distinct().withColumn("__near", F.lit(True))


# ---- revisions


def revisions_by_horizon(estimates: DataFrame, by: list[str], month: str, period: str, horizon: str, value: str, analysts: str, least: int, back: tuple[str, ...] = ("1m", "3m")) -> DataFrame:
    """(by, period, and for each horizon back: revision, flag, reason): the current period's estimate against itself earlier.

    The current period is the first from the month (yyyy/MM) on. estimates has a row for each period and horizon, "now" and
    those back. revision is the change over the old value's size; flag says turned_positive, turned_negative, loss_grew or
    loss_shrank. reason: no_period, few_analysts (fewer than least now), no_source (a value is missing), zero_base.
    """
    w = Window.partitionBy(*by)
    d = estimates.withColumn("__p", F.min(F.when(C(period) >= C(month), C(period))).over(w))
    at = lambda h, c: F.max(F.when((C(period) == C("__p")) & (C(horizon) == h), C(c)))
    g = d.groupBy(*by).agg(F.max("__p").alias("period"), at("now", value).alias("now"), at("now", analysts).alias("n"), *[at(h, value).alias(f"__{h}") for h in back])
    out = [*by, "period"]
    for h in back:
        now, was = C("now"), C(f"__{h}")
        reason = F.when(C("period").isNull(), "no_period").when(F.coalesce(C("n"), F.lit(0)) < least, "few_analysts").when(now.isNull() | was.isNull(), "no_source").when(was == 0, "zero_base")
        flag = F.when((was < 0) & (now > 0), "turned_positive").when((was > 0) & (now < 0), "turned_negative").when((was < 0) & (now < 0), F.when(F.abs(now) > F.abs(was), "loss_grew").otherwise("loss_shrank"))
        out += [F.when(reason.isNull(), (now - was) / F.abs(was)).alias(f"revision_{h}"), F.when(reason.isNull(), flag).alias(f"flag_{h}"), reason.alias(f"reason_{h}")]
    return g.select(out)


# ---- row counts


def row_count_changes(now: DataFrame, before: DataFrame, table: str, fan_out: int = 1) -> DataFrame:
    """(table, d_in, d_out, expected, verdict) of each table's counts (n_in, n_out, n_dedup, n_reject) against the build before.

    The change of the rows out must be that of the rows in times fan_out, less those of duplicates and rejects. A table
    without a build before is skipped, one that is gone is missing.
    """
    counts = ["n_in", "n_out", "n_dedup", "n_reject"]
    b = before.select(C(table).alias("__t"), *[C(c).alias(f"b_{c}") for c in counts])
    j = now.join(b, C(table).eqNullSafe(C("__t")), "full")
    change = {c: C(c) - C(f"b_{c}") for c in counts}
    expected = change["n_in"] * fan_out - change["n_dedup"] - change["n_reject"]
    verdict = F.when(C("b_n_in").isNull(), "skip").when(C("n_in").isNull(), "missing").when(change["n_out"] == expected, "pass").otherwise("fail")
    return j.select(F.coalesce(table, "__t").alias(table), change["n_in"].alias("d_in"), change["n_out"].alias("d_out"), expected.alias("expected"), verdict.alias("verdict"))
