"""Signals and checklist states of daily bars, horizontal zones with their tests, the market's regime.

What a bar is measured by, from means of a fixed number of bars to smoothed values, the volume profile of its last window
and the last swings, comes from one grouped map a security, so bars are shuffled once. A condition with a missing input is
missing, and a signal fires on the first bar of a condition that was known and false on the bar before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import asof_backward
from .technical import smoothed, zigzag_points

C = F.col
CELLS_AT_ONCE = 50_000  # cells of windows by bins that are held at a time, few enough for a core's cache
#: What events compares with the bar before.
COMPARED = [
    "rsi", "macd", "macd_signal", "close", "cloud_top", "conversion", "base", "obv", "obv_top", "close_top", "sma_short", "sd_short", "k", "dline", "ema_short", "ema_middle", "sma_middle", "sma_long", "poc",
    "last_high", "last_low",
]


@dataclass(frozen=True)
class Periods:
    """Lengths in bars of what the signals are made of."""

    short: int = 20
    middle: int = 50
    long: int = 200
    strength: int = 14
    fast: int = 12
    slow: int = 26
    signal: int = 9
    cloud: tuple[int, int, int] = (9, 26, 52)
    stochastic: tuple[int, int, int] = (14, 3, 3)
    profile: int = 120
    bins: int = 50


def profile(high: np.ndarray, low: np.ndarray, volume: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, volumes): each bar's volume shared by its overlap with equal bins from the lowest to the highest price."""
    lo, hi = low.min(), high.max()
    if not hi > lo:
        return np.array([lo, hi]), np.array([volume.sum()])
    edges = np.linspace(lo, hi, bins + 1)
    over = np.minimum(high[:, None], edges[1:]) - np.maximum(low[:, None], edges[:-1])
    span = high - low
    share = np.clip(over, 0, None) / np.where(span > 0, span, 1)[:, None]
    flat = np.minimum(np.searchsorted(edges, low[span <= 0], "right") - 1, bins - 1)
    share[np.flatnonzero(span <= 0), flat] = 1
    return edges, volume @ share


def profiles(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(price of the largest bin, share of volume in bins above the close) of the last n bars up to each bar, by profile.

    Windows are taken CELLS_AT_ONCE cells at a time, not one by one.
    """
    best, above = np.full(len(high), np.nan), np.full(len(high), np.nan)
    if len(high) < n:
        return best, above
    step = max(1, CELLS_AT_ONCE // (n * bins))
    h, lo, vol = (np.lib.stride_tricks.sliding_window_view(x, n) for x in (high, low, volume))
    for at in range(0, len(h), step):
        hs, ls, vs, last = h[at : at + step], lo[at : at + step], vol[at : at + step], np.arange(at + n - 1, min(at + step, len(h)) + n - 1)
        bottom, top = ls.min(1), hs.max(1)
        wide = np.flatnonzero(top > bottom)
        for i in np.flatnonzero(~(top > bottom)):
            edges, v = profile(hs[i], ls[i], vs[i], bins)
            middle = (edges[:-1] + edges[1:]) / 2
            best[last[i]] = middle[v.argmax()]
            if v.sum() > 0:
                above[last[i]] = v[middle > close[last[i]]].sum() / v.sum()
        hs, ls, vs, last = hs[wide], ls[wide], vs[wide], last[wide]
        edges = np.linspace(bottom[wide], top[wide], bins + 1, axis=1)
        over = np.minimum(hs[:, :, None], edges[:, None, 1:]) - np.maximum(ls[:, :, None], edges[:, None, :-1])
        span = hs - ls
        share = np.clip(over, 0, None) / np.where(span > 0, span, 1)[:, :, None]
        w, b = np.nonzero(span <= 0)
        share[w, b, np.minimum((edges[w] <= ls[w, b][:, None]).sum(1) - 1, bins - 1)] = 1
        v = np.matmul(vs[:, None, :], share)[:, 0, :]
        middle = (edges[:, :-1] + edges[:, 1:]) / 2
        best[last] = np.take_along_axis(middle, v.argmax(1)[:, None], 1)[:, 0]
        total = v.sum(1)
        some = total > 0
        above[last[some]] = np.where(middle > close[last][:, None], v, 0).sum(1)[some] / total[some]
    return best, above


def rolled(x: np.ndarray, n: int, f, back: int = 0) -> np.ndarray:
    """f of the n values up to each bar, or up to back bars before it; NaN unless all are there. f gets them from the first on."""
    out = np.full(len(x), np.nan)
    m = len(x) - n - back + 1
    if m > 0:
        out[n + back - 1 :] = f([x[j : j + m] for j in range(n)])
    return out


# of values from the first on, in the order in which a window's aggregates take them
def lowest(xs: list[np.ndarray]) -> np.ndarray:
    return reduce(np.minimum, xs)


def highest(xs: list[np.ndarray]) -> np.ndarray:
    return reduce(np.maximum, xs)


def mean(xs: list[np.ndarray]) -> np.ndarray:
    return reduce(np.add, xs) / len(xs)


def deviation(xs: list[np.ndarray]) -> np.ndarray:
    middle = squares = np.zeros(len(xs[0]))
    for i, x in enumerate(xs, 1):
        off = x - middle
        step = off / i
        middle, squares = middle + step, squares + off * (off - step)
    return np.sqrt(squares / len(xs))


def measures(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, p: Periods, turns: tuple[int, float] | None = None) -> dict[str, np.ndarray]:
    """What measured adds to a security's bars in their order; NaN where a value isn't there."""
    before = np.r_[np.nan, close[:-1]]
    change = close - before
    span = np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))
    ema = lambda x, k: smoothed(x, k, 2 / (k + 1))
    gain, fall = (smoothed(np.clip(s * change, 0, None), p.strength, 1 / p.strength) for s in (1, -1))
    macd = ema(close, p.fast) - ema(close, p.slow)
    best, above = profiles(high, low, close, volume, p.profile, p.bins)
    moved = np.where(np.isnan(change), 0.0, np.sign(change)) * volume
    obv = np.where(np.logical_and.accumulate(np.isnan(moved)), np.nan, np.cumsum(np.where(np.isnan(moved), 0.0, moved)))
    half = lambda n, back=0: (rolled(high, n, highest, back) + rolled(low, n, lowest, back)) / 2
    a, b, c = p.cloud
    n, smooth_k, smooth_d = p.stochastic
    bottom, top = rolled(low, n, lowest), rolled(high, n, highest)
    with np.errstate(invalid="ignore", divide="ignore"):
        rsi = np.where(np.isnan(gain), np.nan, np.where(fall == 0, 100.0, gain / (gain + fall) * 100))
        raw_k = np.where(top == bottom, np.nan, (close - bottom) / (top - bottom) * 100)
    k = rolled(raw_k, smooth_k, mean)
    out = {
        "obv": obv, "sma_middle": rolled(close, p.middle, mean), "sma_long": rolled(close, p.long, mean), "sma_short": rolled(close, p.short, mean), "sd_short": rolled(close, p.short, deviation),
        "obv_mean": rolled(obv, p.short, mean), "obv_top": rolled(obv, p.short, highest, 1), "close_top": rolled(close, p.short, highest, 1), "conversion": half(a), "base": half(b),
        "k": k, "dline": rolled(k, smooth_d, mean), "cloud_top": np.maximum((half(a, b) + half(b, b)) / 2, half(c, b)),
        "ema_short": ema(close, p.short), "ema_middle": ema(close, p.middle), "rsi": rsi, "macd": macd, "macd_signal": ema(macd, p.signal), "atr": smoothed(span, p.strength, 1 / p.strength),
        "poc": np.r_[np.nan, best[:-1]], "above": above,  # poc is of the bars before a bar
    }
    if turns:
        out |= last_swings(zigzag_points(high, low, smoothed(span, turns[0], 1 / turns[0]) * turns[1]), len(close))
    return out


MEASURED = [
    "obv", "sma_middle", "sma_long", "sma_short", "sd_short", "obv_mean", "obv_top", "close_top", "conversion", "base", "k", "dline", "cloud_top", "ema_short", "ema_middle", "rsi", "macd", "macd_signal", "atr",
    "poc", "above",
]


def measured(bars: DataFrame, by: str, at: str, p: Periods = Periods(), turns: tuple[int, float] | None = None, before: bool = False) -> DataFrame:
    """bars (by, at, open, high, low, close, volume) with everything that the signals need; null where it isn't defined yet.

    With turns, (bars, factor) of zigzag, also last_high and last_low as with_last_swings has them of those swings; with
    before, was_x for each x that events compares with the bar before. It is all one grouped map a security, so bars that lie
    together by security are not shuffled again, and nothing after it needs the rows in order.
    """
    names = MEASURED + (["last_high", "last_low"] if turns else [])
    was = [x for x in COMPARED if x in names or x in bars.columns] if before else []

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by(at).combine_chunks()
        out = measures(*(g[c].to_numpy().astype(float) for c in ("high", "low", "close", "volume")), p, turns)
        columns = {c: g[c].combine_chunks() for c in g.column_names} | {c: pa.array(out[c], from_pandas=True) for c in names}
        lagged = {f"was_{c}": pa.concat_arrays([pa.nulls(1, columns[c].type), columns[c].slice(0, len(g) - 1)]) for c in was}
        return pa.table(columns | lagged)

    schema = T.StructType([*bars.schema.fields])
    for x in names:
        schema = schema.add(x, "double")
    for x in was:
        schema = schema.add(f"was_{x}", schema[x].dataType)
    return bars.where(C(by).isNotNull() & C(at).isNotNull()).groupBy(by).applyInArrow(run, schema)


def last_swings(points: list[tuple[int, str, float, int]], n: int) -> dict[str, np.ndarray]:
    """last_high and last_low: the price of the last swing of each kind confirmed by each of n bars; NaN before the first."""
    out = {}
    for kind in ("high", "low"):
        at, price = np.full(n, -1), np.full(n, np.nan)
        for _, k, value, confirmed in points:
            if k == kind:
                at[confirmed], price[confirmed] = confirmed, value
        at = np.maximum.accumulate(at)
        out[f"last_{kind}"] = np.where(at < 0, np.nan, price[at])
    return out


def with_last_swings(df: DataFrame, swings: DataFrame, by: str, at: str) -> DataFrame:
    """df with last_high and last_low: the last swings of each kind confirmed by a bar."""
    for kind in ("high", "low"):
        # of swings confirmed on one bar the later one
        s = swings.where(C("kind") == kind).groupBy(by, C("confirmed").alias(at)).agg(F.max_by("price", at).alias(f"last_{kind}"))
        df = asof_backward(df, s, [by], at, [f"last_{kind}"]).drop(f"{at}_matched")
    return df


def events(df: DataFrame, by: str, at: str) -> DataFrame:
    """(by, at, signal): A1 to A15 on the bars on which they fire, from measured and with_last_swings.

    A1, A2 strength under 30, over 70; A3, A4 MACD over, under its signal line; A5 close over the cloud; A6 conversion over
    base line; A7 balance volume at a new high while the close is not; A8, A9 close outside the bands; A10 stochastic turns
    up below 20; A11, A12 short over middle, middle over long mean; A13 close over the point of control; A14, A15 close
    crosses the last swing high upwards, the last swing low downwards.
    """
    w = Window.partitionBy(by).orderBy(at)
    df = df.withColumns({f"was_{x}": F.lag(x).over(w) for x in COMPARED if f"was_{x}" not in df.columns})

    def conditions(v) -> dict[str, Column]:
        lower, upper = v("sma_short") - 2 * v("sd_short"), v("sma_short") + 2 * v("sd_short")
        return {
            "A1": v("rsi") < 30, "A2": v("rsi") > 70, "A3": v("macd") > v("macd_signal"), "A4": v("macd") < v("macd_signal"), "A5": v("close") > v("cloud_top"), "A6": v("conversion") > v("base"),
            "A7": (v("obv") > v("obv_top")) & (v("close") <= v("close_top")), "A8": v("close") < lower, "A9": v("close") > upper, "A10": v("k") > v("dline"), "A11": v("ema_short") > v("ema_middle"),
            "A12": v("sma_middle") > v("sma_long"), "A13": v("close") > v("poc"),
        }

    was = lambda x: C(f"was_{x}")
    now, then = conditions(C), conditions(was)
    fresh = {k: now[k] & ~then[k] for k in now}
    fresh["A10"] = fresh["A10"] & (C("dline") < 20)
    fresh["A14"] = (C("close") > was("last_high")) & (was("close") <= was("last_high"))
    fresh["A15"] = (C("close") < was("last_low")) & (was("close") >= was("last_low"))
    d = df.withColumn("__on", F.array_compact(F.array(*[F.when(v, k) for k, v in fresh.items()])))
    return d.select(by, at, F.explode("__on").alias("signal"))


def states(df: DataFrame, by: str, at: str) -> DataFrame:
    """(by, at, D1 .. D10 as booleans, D11): the checklist of each bar; D11 counts what holds, null if anything is unknown."""
    upper = C("sma_short") + 2 * C("sd_short")
    s = {
        "D1": C("close") > C("ema_short"), "D2": C("ema_short") > C("ema_middle"), "D3": C("close") > C("sma_long"), "D4": C("macd") > C("macd_signal"), "D5": C("close") > C("cloud_top"),
        "D6": C("rsi").between(40, 70), "D7": C("obv") > C("obv_mean"), "D8": (C("close") > C("sma_short")) & (C("close") <= upper), "D9": (C("k") > C("dline")) & (C("k") < 80), "D10": C("above") < 0.30,
    }
    # a condition on several values is unknown if one of them is, even where another decides
    needs = {"D8": upper.isNotNull(), "D9": C("k").isNotNull() & C("dline").isNotNull()}
    named = [F.when(needs[k], v).alias(k) if k in needs else v.alias(k) for k, v in s.items()]
    d = df.select(by, at, *named)
    total = sum((C(k).cast("int") for k in s), F.lit(0))
    return d.withColumn("D11", total)


TOUCH_GAP = 5


def tested_zones(pivots: DataFrame, bars: DataFrame, by: str, at: str, width_atr: float = 1.0, least: int = 2) -> DataFrame:
    """(by, lo, hi, touches, formed, held, broken): zones of swing prices and how later visits ended.

    Swings in order of price are one zone while the logarithm of their ratio to its lowest is within width_atr average
    ranges of the last bar's close. Swings within TOUCH_GAP bars of the one before touch once; zones with fewer than least
    touches go. A zone is formed once its last swing is confirmed and the tolerance of the day covers it. Of each visit
    after that (bars that meet the zone, one after the other) the close before and the close after are compared: back on
    the same side it held, on the other it broke; a visit from inside, or one that lasts to the end, says nothing.
    pivots: (by, at, price, confirmed); bars: (by, at, high, low, close, atr). Each security is one group.
    """
    t = dict(bars.dtypes)
    null = lambda kind: F.lit(None).cast(kind)
    rows = bars.select(by, at, "high", "low", "close", "atr", null("double").alias("price"), null("long").alias("confirmed"))
    rows = rows.unionByName(pivots.select(by, at, *[null("double").alias(c) for c in ("high", "low", "close", "atr")], "price", C("confirmed").cast("long").alias("confirmed")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        b, p = g[g["price"].isna()].sort_values(at), g[g["price"].notna()].sort_values(["price", at])
        out = []
        if len(b) and len(p):
            place = {v: i for i, v in enumerate(b[at])}
            high, low, close = (b[c].to_numpy(float) for c in ("high", "low", "close"))
            tolerance = width_atr * b["atr"].to_numpy(float) / close
            logs = np.log(p["price"].to_numpy(float))
            first = 0
            for i in range(1, len(p) + 1):
                if i < len(p) and logs[i] - logs[first] <= tolerance[-1]:
                    continue
                zone, first = p.iloc[first:i], i
                order = np.sort(zone[at].to_numpy())
                touches = 1 + int((np.diff(order) > TOUCH_GAP).sum())
                if touches < least:
                    continue
                lo, hi = zone["price"].iloc[0], zone["price"].iloc[-1]
                begin = place[zone["confirmed"].max()]
                wide = np.flatnonzero(tolerance[begin:] >= np.log(hi / lo))
                begin += int(wide[0]) if len(wide) else len(b) - 1 - begin
                inside = (low <= hi) & (high >= lo)
                side = np.where(close > hi, 1, np.where(close < lo, -1, 0))
                edge = np.flatnonzero(np.diff(np.r_[False, inside[begin + 1 :], False]))
                visits = [(begin + 1 + s, begin + e) for s, e in zip(edge[::2], edge[1::2], strict=True) if begin + e + 1 < len(b)]
                held = sum(side[s - 1] != 0 and side[e + 1] == side[s - 1] for s, e in visits)
                broken = sum(side[s - 1] != 0 and side[e + 1] == -side[s - 1] for s, e in visits)
                out.append((g[by].iloc[0], lo, hi, touches, b[at].iloc[begin], int(held), int(broken)))
        return pd.DataFrame(out, columns=[by, "lo", "hi", "touches", "formed", "held", "broken"])

    return rows.groupBy(by).applyInPandas(run, f"{by} {t[by]}, lo double, hi double, touches int, formed {t[at]}, held int, broken int")


# The verdicts' bounds.
MIN_BARS, FLAT, TREND, BOX = 20, 0.5, 1.0, 3.0


def significant(swings: DataFrame, bars: DataFrame, by: str, at: str, window: int) -> DataFrame:
    """swings with major: no bar of the window before and after is beyond them, and all of those bars are there."""
    w = Window.partitionBy(by).orderBy(at)
    around = lambda f, c: F.greatest(f(c).over(w.rowsBetween(-window, -1)), f(c).over(w.rowsBetween(1, window)))
    below = F.least(F.min("low").over(w.rowsBetween(-window, -1)), F.min("low").over(w.rowsBetween(1, window)))
    whole = (F.count("*").over(w.rowsBetween(-window, -1)) == window) & (F.count("*").over(w.rowsBetween(1, window)) == window)
    b = bars.select(by, at, around(F.max, "high").alias("__hi"), below.alias("__lo"), whole.alias("__whole"))
    j = swings.join(b, [by, at], "left")
    major = C("__whole") & F.when(C("kind") == "high", C("__hi") <= C("price")).otherwise(C("__lo") >= C("price"))
    return j.withColumn("major", F.coalesce(major, F.lit(False))).drop("__hi", "__lo", "__whole")


def regimes(bars: DataFrame, swings: DataFrame, by: str, at: str, n: int) -> DataFrame:
    """(by, bars, strength, box, structure, verdict, reason) of each security's last n bars.

    strength is the logarithm of the way over the deviation of a bar's way times the root of the steps; box the span of
    prices over the last average range times the root of the bars. structure compares the last two major swing highs and
    lows confirmed inside: up, down, mixed or insufficient. A flat strength is a box if the box is small, else unclear; a
    trend needs its structure, else the verdict is to hold, as it is for a weak strength.
    """
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))
    w = Window.partitionBy(by).orderBy(at)
    d = bars.withColumn("__r", back).where(C("__r") <= n)
    d = d.withColumn("__way", F.log(C("close") / F.lag("close").over(w)))
    g = d.groupBy(by).agg(
        F.count("*").alias("bars"), F.min(at).alias("from"), F.max(at).alias("to"), F.min_by("close", at).alias("c0"), F.max_by("close", at).alias("c1"), F.stddev_samp("__way").alias("sd"),
        F.max_by("atr", at).alias("atr"), (F.max("high") - F.min("low")).alias("span"),
    )
    s = swings.where("major").join(g.select(by, "from", "to"), by).where(C(at).between(C("from"), C("to")) & (C("confirmed") <= C("to")))
    s = s.withColumn("__r", F.row_number().over(Window.partitionBy(by, "kind").orderBy(F.desc(at)))).where("__r <= 2")
    last = lambda kind, r: F.max(F.when((C("kind") == kind) & (C("__r") == r), C("price"))).alias(f"{kind}{r}")
    s = s.groupBy(by).agg(*[last(k, r) for k in ("high", "low") for r in (1, 2)])
    g = g.join(s, by, "left")
    ups, downs = (C("high1") > C("high2")) & (C("low1") > C("low2")), (C("high1") < C("high2")) & (C("low1") < C("low2"))
    structure = F.when(C("high2").isNull() | C("low2").isNull(), "insufficient").when(ups, "up").when(downs, "down").otherwise("mixed")
    blind = F.when(C("bars") < MIN_BARS, "too_few_bars").when(C("sd").isNull() | (C("sd") == 0) | C("atr").isNull() | (C("atr") == 0), "degenerate")
    g = g.withColumn("structure", structure).withColumn("blind", blind)
    g = g.withColumn("strength", F.when(C("blind").isNull(), F.log(C("c1") / C("c0")) / (C("sd") * F.sqrt(C("bars") - 1))))
    g = g.withColumn("box", F.when(C("blind").isNull(), C("span") / (C("atr") * F.sqrt("bars"))))
    way = F.when(C("strength") > 0, "up").otherwise("down")
    size = F.abs("strength")
    verdict = (
        F.when(C("blind").isNotNull(), "undecidable").when(size < FLAT, F.when(C("box") <= BOX, "box").otherwise("unclear")).when(size < TREND, "hold")
        .when(C("structure") == way, way).otherwise("hold")
    )
    reason = F.coalesce("blind", F.when((size >= FLAT) & (size < TREND), "weak_strength").when((size >= TREND) & (C("structure") != way), "structure_mismatch"))
    return g.select(by, "bars", "strength", "box", "structure", verdict.alias("verdict"), reason.alias("reason"))
