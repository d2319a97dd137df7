"""Chart shapes over swing points, flags, candles and gaps, and trend channels.

Swing shapes are conditions on a few consecutive swings, which windows put side by side; the sessions on which a shape may
break out are then met by equality, at most BREAK_WITHIN for each. Only channels walk a security's swings in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col

# The shapes' limits.
SAME_LEVEL = 0.04
MAX_SPAN, BREAK_WITHIN = 63, 20
MIN_DEPTH, SHOULDERS = 0.03, (0.25, 0.70)
DOUBLE_GAP, BOX_HEIGHT = 22, (0.05, 0.30)
POLE_BARS, POLE_RISE, FLAG_BARS = 10, 0.15, (5, 15)
MIN_CHANNEL_BARS = 20


def _same(a: Column, b: Column) -> Column:
    return F.abs(a - b) / ((a + b) / 2) <= SAME_LEVEL


def swing_shapes(pivots: DataFrame, bars: DataFrame, by: str, at: str) -> DataFrame:
    """(by, shape, complete, first, last, level): shapes H1 to H6 on the bar that completes them.

    pivots: (by, at, kind, price, confirmed), bars: (by, at, close), at and confirmed the bar's number in its security.
    H1, H2 head and shoulders and its inverse; H3, H4 double top and bottom; H5 a box, H6 a falling triangle, both left
    upwards. A shape is complete on the first bar, from the confirmation of its last swing on, whose close is beyond its
    line: within BREAK_WITHIN bars of that swing, MAX_SPAN of its first, and before another swing is confirmed. level is the
    line's value there.
    """
    d = pivots.select(by, C(at).alias("x1"), C("price").alias("e1"), "kind", "confirmed")
    w = Window.partitionBy(by).orderBy("x1")
    for i in (2, 3, 4, 5):
        d = d.withColumn(f"x{i}", F.lead("x1", i - 1).over(w)).withColumn(f"e{i}", F.lead("e1", i - 1).over(w))
    for i in (3, 4, 5, 6):
        d = d.withColumn(f"c{i}", F.lead("confirmed", i - 1).over(w))
    e, x = {i: C(f"e{i}") for i in range(1, 6)}, {i: C(f"x{i}") for i in range(1, 6)}
    high, low = C("kind") == "high", C("kind") == "low"
    head = F.abs(e[3] - (e[2] + e[4]) / 2)
    shoulder = F.abs((e[1] - e[2]) + (e[5] - e[4])) / 2
    necked = _same(e[1], e[5]) & _same(e[2], e[4]) & (head > 0) & F.try_divide(shoulder, head).between(*SHOULDERS) & (head / e[3] >= MIN_DEPTH)
    top = (e[1] + e[3]) / 2
    twice = (x[3] - x[1] > DOUBLE_GAP) & _same(e[1], e[3])
    highs = F.when(high, F.array(e[1], e[3])).otherwise(F.array(e[2], e[4]))
    lows = F.when(high, F.array(e[2], e[4])).otherwise(F.array(e[1], e[3]))
    height = (highs[0] + highs[1]) / (lows[0] + lows[1]) - 1
    boxed = _same(highs[0], highs[1]) & _same(lows[0], lows[1]) & height.between(*BOX_HEIGHT)
    flat = lambda v: (F.lit(0).cast("long"), v, F.lit(1).cast("long"), v)
    neck, falling = (x[2], e[2], x[4], e[4]), (x[3], e[3], x[5], e[5])
    # both shoulders are above a neck of lows, or below one of highs
    right = lambda s: ((e[1] - e[2]) + (e[5] - e[4])) * s > 0
    kinds = [
        ("H1", high & (e[3] > e[1]) & (e[3] > e[5]) & necked & right(1), 5, neck, False), ("H2", low & (e[3] < e[1]) & (e[3] < e[5]) & necked & right(-1), 5, neck, True),
        ("H3", high & twice & ((top - e[2]) / top >= MIN_DEPTH), 3, flat(e[2]), False), ("H4", low & twice & ((e[2] - top) / top >= MIN_DEPTH), 3, flat(e[2]), True),
        ("H5", boxed, 4, flat(F.greatest(highs[0], highs[1])), True), ("H6", high & (e[1] > e[3]) & (e[3] > e[5]) & (e[2] < e[4]), 5, falling, True),
    ]
    rows = []
    for name, holds, n, line, up in kinds:
        stop = F.least(x[n] + BREAK_WITHIN, x[1] + MAX_SPAN, F.coalesce(C(f"c{n + 1}") - 1, x[n] + BREAK_WITHIN))
        fields = [F.lit(name).alias("shape"), x[1].alias("first"), x[n].alias("last"), C(f"c{n}").alias("start"), stop.alias("stop"), *[v.alias(k) for k, v in zip(("a", "ya", "b", "yb"), line, strict=True)], F.lit(up).alias("up")]
        rows.append(F.when(F.coalesce(holds, F.lit(False)) & x[n].isNotNull(), F.struct(*fields)))
    d = d.select(by, F.explode(F.array_compact(F.array(*rows))).alias("s")).select(by, "s.*").where("start <= stop")
    t = d.withColumn(at, F.explode(F.sequence("start", "stop"))).join(bars.select(by, at, "close"), [by, at])
    level = C("ya") + (C("yb") - C("ya")) * (C(at) - C("a")) / (C("b") - C("a"))
    t = t.withColumn("level", level).where(F.when(C("up"), C("close") > C("level")).otherwise(C("close") < C("level")))
    done = t.groupBy(by, "shape", "first", "last").agg(F.min(F.struct(at, "level")).alias("m"))
    return done.select(by, "shape", C(f"m.{at}").alias("complete"), "first", "last", "m.level")


def flags(bars: DataFrame, by: str, at: str) -> DataFrame:
    """(by, shape, complete, first, last, level): H7, a pole of POLE_RISE in POLE_BARS, then a flag that a close leaves upwards.

    The flag's bars, FLAG_BARS of them, stay under the pole's high and above half its rise. Of poles that complete on one
    bar the first counts.
    """
    w = Window.partitionBy(by).orderBy(at)
    longest = FLAG_BARS[1]
    d = bars.withColumn("base", F.min("close").over(w.rowsBetween(-POLE_BARS, -1))).withColumn("__n", F.row_number().over(w))
    d = d.withColumn("next", F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, longest + 1)))
    d = d.where((C("__n") > POLE_BARS) & (C("close") / C("base") - 1 >= POLE_RISE))
    floor = C("close") - 0.5 * (C("close") - C("base"))
    broken = F.filter(F.transform("next", lambda b, i: F.when((b["high"] > C("high")) | (b["low"] < floor), i)), lambda i: i.isNotNull())
    d = d.withColumn("__flag", F.coalesce(F.get(broken, F.lit(0)), F.size("next")))  # bars before the first that breaks it
    tops = lambda m: F.array_max(F.transform(F.slice("next", 1, m), lambda b: b["high"]))
    fits = F.filter(F.sequence(F.lit(FLAG_BARS[0]), F.lit(longest)), lambda m: (m <= C("__flag")) & (F.size("next") > m) & (F.get(C("next"), m)["close"] > tops(m)))
    d = d.withColumn("m", F.get(fits, F.lit(0))).where("m IS NOT NULL")
    d = d.select(by, (C(at) + C("m") + 1).alias("complete"), C(at).alias("first"), tops(C("m")).alias("level"))
    one = F.row_number().over(Window.partitionBy(by, "complete").orderBy("first"))
    return d.withColumn("__r", one).where("__r = 1").select(by, F.lit("H7").alias("shape"), "complete", "first", C("first").alias("last"), "level")


def candle_shapes(bars: DataFrame, by: str, at: str) -> DataFrame:
    """(by, shape, complete) from bars with an average range atr: C1 a rising engulfing bar after a fall, C2 a long rising bar,
    G1 and G2 gaps upwards and downwards that stay open. Ranges are those of the bar before."""
    w = Window.partitionBy(by).orderBy(at)
    was = lambda c, n=1: F.lag(c, n).over(w)
    d = bars.select("*", was("atr").alias("a"), was("open").alias("po"), was("close").alias("pc"), was("high").alias("ph"), was("low").alias("pl"), was("close", 6).alias("pc6"))
    body = C("close") - C("open")
    known = C("a").isNotNull() & ~F.isnan("a")
    shapes = {
        "C1": known & C("pc6").isNotNull() & (C("pc") < C("po")) & (body > 0) & (C("open") <= C("pc")) & (C("close") >= C("po")) & (body >= 0.5 * C("a")) & (C("pc") / C("pc6") < 1),
        "C2": known & (body >= 2 * C("a")) & (C("high") > C("low")) & ((C("close") - C("low")) / (C("high") - C("low")) >= 0.75),
        "G1": (C("open") >= C("pc") * 1.03) & (C("low") > C("ph")),
        "G2": (C("open") <= C("pc") * 0.97) & (C("high") < C("pl")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), k) for k, v in shapes.items()]))
    return d.select(by, F.explode(found).alias("shape"), C(at).alias("complete"))


def supports(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point the later one whose line has no later point below it, -1 for the last; x ascends.

    That is the next corner of the lower hull of the points from there on: one pass from the right with a stack.
    """
    out, hull = np.full(len(x), -1), []
    slope = lambda i, j: (y[j] - y[i]) / (x[j] - x[i])
    for i in range(len(x) - 1, -1, -1):
        while len(hull) > 1 and slope(i, hull[-1]) >= slope(i, hull[-2]):
            hull.pop()
        if hull:
            out[i] = hull[-1]
        hull.append(i)
    return out


def trend_channels(pivots: DataFrame, bars: DataFrame, by: str, at: str, best: int) -> DataFrame:
    """(by, direction, x1, x2, y1, y2, width_at, width_atr, outside, span, rank): the best channels of each security.

    A rising channel stands on two swing lows, the second at least an average range higher, with no later low under their
    line; its width is that of the highest swing high above it after the first. Falling ones are the same turned over. They
    are ranked: shorter than MIN_CHANNEL_BARS last, then by the share of closes outside since the first swing, then by
    width. pivots: (by, at, kind, price), bars: (by, at, close, atr); a security's bars meet its lines in one group.
    """
    p = pivots.select(by, C(at).cast("long").alias("x"), C("price").cast("double").alias("y"), "kind", F.lit(None).cast("double").alias("atr"))
    b = bars.select(by, C(at).cast("long").alias("x"), C("close").cast("double").alias("y"), F.lit("bar").alias("kind"), C("atr").cast("double").alias("atr"))
    key = dict(pivots.dtypes)[by]
    schema = f"{by} {key}, direction string, x1 long, x2 long, y1 double, y2 double, width_at long, width_atr double, outside long, span long"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x", kind="stable")
        close = g[g["kind"] == "bar"]
        unit = float(close["atr"].iloc[-1]) if len(close) else np.nan
        out = []
        for direction, base, far, sign in (("up", "low", "high", 1.0), ("down", "high", "low", -1.0)):
            a, o = g[g["kind"] == base], g[g["kind"] == far]
            x, y = a["x"].to_numpy(), sign * a["y"].to_numpy()
            ox, oy, cx, cy = o["x"].to_numpy(), sign * o["y"].to_numpy(), close["x"].to_numpy(), sign * close["y"].to_numpy()
            for i, j in enumerate(supports(x, y)):
                if j < 0 or not unit > 0 or y[j] - y[i] < unit:
                    continue
                k = (y[j] - y[i]) / (x[j] - x[i])
                gap = np.where(ox > x[i], oy - (y[i] + k * (ox - x[i])), -np.inf)
                if not len(gap) or gap.max() <= 0:
                    continue
                over = cy[cx >= x[i]] - (y[i] + k * (cx[cx >= x[i]] - x[i]))
                outside = int(((over < 0) | (over > gap.max())).sum())
                out.append((g[by].iloc[0], direction, x[i], x[j], sign * y[i], sign * y[j], ox[gap.argmax()], gap.max() / unit, outside, cx[-1] - x[i] + 1))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    d = p.unionByName(b).groupBy(by).applyInPandas(run, schema)
    order = Window.partitionBy(by, "direction").orderBy(C("span") < MIN_CHANNEL_BARS, C("outside") / C("span"), "width_atr", "x1")
    return d.withColumn("rank", F.row_number().over(order)).where(C("rank") <= best)
