"""Fans of parallel lines through three swings, scored by how often prices turn at them against the same fan moved at random.

The lines of a fan are equally far apart, so the line that a bar meets first is found by a division, whatever the number of
lines. Each day's touch and its end are found for all days, fans and random moves at once; then each fan goes from touch to touch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
SIDE_BY_SIDE = 32  # fans worked on at once, which bounds the memory of a task


@dataclass(frozen=True)
class Rules:
    """A fan's lines are step of its width apart. Swings of its base are least_gap bars apart; after its third there are
    least_bars, of which the last most_bars count. touch and move are in average ranges, horizon in bars."""

    step: float = 0.5
    least_gap: int = 60
    least_bars: int = 60
    most_bars: int = 500
    recent: int = 8
    touch: float = 0.25
    move: float = 1.0
    horizon: int = 10
    moves: int = 20
    seed: int = 0


def candidates(x: np.ndarray, price: np.ndarray, low: np.ndarray, rules: Rules, spacing: float) -> list[tuple[str, int, int, int]]:
    """(direction, a, b, c), numbers of swings: rising fans stand on two lows, the second higher, and reach to a high after the
    first; falling ones the other way round. Of each kind the recent swings; lines at least spacing apart."""
    out = []
    for direction, base, s in (("up", low, 1.0), ("down", ~low, -1.0)):
        feet, tops = (np.flatnonzero(k)[-rules.recent :] for k in (base, ~base))
        for i, a in enumerate(feet):
            for b in feet[i + 1 :]:
                if x[b] - x[a] < rules.least_gap or s * (price[b] - price[a]) <= 0:
                    continue
                at = price[a] + (price[b] - price[a]) / (x[b] - x[a]) * (x[tops] - x[a])
                width = s * (price[tops] - at)
                out += [(direction, int(a), int(b), int(c)) for c in tops[(x[tops] > x[a]) & (width > 0) & (rules.step * width >= spacing)]]
    return out


def turns(close: np.ndarray, high: np.ndarray, low: np.ndarray, size: np.ndarray, base: np.ndarray, span: np.ndarray, rules: Rules) -> np.ndarray:
    """(turned, pierced) of each row of base, the value of one of its lines a day; its others are whole numbers of span away.

    A day's touch is the first line met from the close before: from above if the low comes within touch of it, from below if
    the high does; of both the nearer, the upper on a tie. It ends with the first of horizon closes that is move away from
    that line: back is a turn, through is piercing. The next touch is sought after that day, or after the horizon. A touch
    whose horizon is not there yet ends the count.
    """
    n, days = base.shape
    out = np.zeros((n, 2), int)
    at = np.flatnonzero(~(np.isnan(size[:-1]) | np.isnan(close[:-1]) | np.isnan(low[1:]) | np.isnan(high[1:]))) + 1
    a, before = size[at - 1], close[at - 1]
    tol, here, gap = rules.touch * a, base[:, at], span[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        # the highest line strictly under the close less tol, and the lowest strictly over the close plus tol
        under = here + (np.ceil((before - tol - here) / gap) - 1) * gap
        over = here + (np.floor((before + tol - here) / gap) + 1) * gap
        from_above, from_below = low[at] <= under + tol, high[at] >= over - tol
        upper = from_above & (~from_below | (over - before >= before - under))
        row, t = np.nonzero(upper | from_below)
        upper = upper[row, t]
        k = np.round((np.where(upper, under[row, t], over[row, t]) - here[row, t]) / span[row])
        # the end of each touch, were it to count: its day, and whether prices turned
        day, side, far, move = at[t], np.where(upper, 1.0, -1.0), k * span[row], rules.move * a[t]
        first, turned, left = np.full(len(row), rules.horizon), np.zeros(len(row), bool), np.arange(len(row))
        for h in range(rules.horizon):
            left = left[day[left] + h < days]
            d = day[left] + h
            way = side[left] * (close[d] - (base[row[left], d] + far[left])) / move[left]
            ends = np.abs(np.where(np.isnan(way), 0, way)) >= 1
            first[left[ends]], turned[left[ends]] = h, way[ends] > 0
            left = left[~ends]
    said = first < rules.horizon
    stop = days + 1
    free = np.where(said, day + first + 1, np.where(day + rules.horizon > days, stop, day + rules.horizon))
    # which touch is the first of its row from a day on; none is len(row)
    first_from = np.full((n, stop + rules.horizon + 1), len(row))
    first_from[row, day] = np.arange(len(row))
    first_from = np.minimum.accumulate(first_from[:, ::-1], axis=1)[:, ::-1]
    now = first_from[:, 1]
    while len(now := now[now < len(row)]):
        np.add.at(out, (row[now[said[now]]], np.where(turned[now[said[now]]], 0, 1)), 1)
        now = first_from[row[now], free[now]]
    return out


def fan_scores(swings: DataFrame, bars: DataFrame, by: str, at: str, rules: Rules = Rules(), best: int = 3) -> DataFrame:
    """(by, direction, xa, xb, xc, turns, expected, deviation, score, p, pierces, rank): each security's best fans.

    score is the turns more than the mean of the moved fans, over their deviation, 1 at least; p the share of all fans, moved
    or not, that turn prices at least as often. Moves are uniform in one spacing, drawn anew for each fan from the seed, so a
    fan's score doesn't depend on others. swings: major ones (by, at, kind, price); bars: (by, at, high, low, close, atr).
    """
    null = lambda kind: F.lit(None).cast(kind)
    rows = bars.select(by, C(at).cast("long").alias("x"), "high", "low", "close", "atr", null("string").alias("kind"), null("double").alias("price"))
    rows = rows.unionByName(swings.select(by, C(at).cast("long").alias("x"), *[null("double").alias(c) for c in ("high", "low", "close", "atr")], "kind", "price"))
    schema = f"{by} {dict(bars.dtypes)[by]}, direction string, xa long, xb long, xc long, turns int, expected double, deviation double, score double, p double, pierces int, rank int"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        b, s = g[g["kind"].isna()].sort_values("x"), g[g["kind"].notna()].sort_values("x")
        x, high, low, close, atr = (b[c].to_numpy(float) for c in ("x", "high", "low", "close", "atr"))
        sx, price = s["x"].to_numpy(float), s["price"].to_numpy(float)
        found, begins = [], {}
        if len(b) and not np.isnan(atr[-1]):
            for direction, i, j, k in candidates(sx, price, (s["kind"] == "low").to_numpy(), rules, atr[-1]):
                if x[-1] - sx[k] < rules.least_bars:
                    continue
                begin = int(np.searchsorted(x, max(sx[k] + 1, x[-1] - rules.most_bars + 1))) - 1
                slope = (price[j] - price[i]) / (sx[j] - sx[i])
                span = abs(rules.step * (price[k] - price[i] - slope * (sx[k] - sx[i])))
                begins.setdefault(begin, []).append((direction, i, j, k, slope, span))
        for begin, some in ((b, f[at : at + SIDE_BY_SIDE]) for b, f in begins.items() for at in range(0, len(f), SIDE_BY_SIDE)):
            days = slice(begin, len(x))
            moved = [np.r_[0.0, np.random.default_rng(rules.seed).uniform(0.0, span, rules.moves)] for *_, span in some]
            base = [price[i] + slope * (x[days] - sx[i]) + m[:, None] for (_, i, _, _, slope, _), m in zip(some, moved, strict=True)]
            spans = np.repeat([span for *_, span in some], rules.moves + 1)
            t = turns(close[days], high[days], low[days], atr[days], np.vstack(base), spans, rules).reshape(len(some), rules.moves + 1, 2)
            for (direction, i, j, k, _, _), one in zip(some, t, strict=True):
                real, null_ = one[0, 0], one[1:, 0]
                score = (real - null_.mean()) / max(null_.std(), 1.0)
                found.append((g[by].iloc[0], direction, int(sx[i]), int(sx[j]), int(sx[k]), int(real), null_.mean(), null_.std(), score, (1 + (null_ >= real).sum()) / (1 + len(null_)), int(one[0, 1])))
        out = []
        for direction in ("up", "down"):
            some = sorted((f for f in found if f[1] == direction), key=lambda f: (-f[8], -f[4], f[2], f[3]))[:best]
            out += [(*f, n + 1) for n, f in enumerate(some)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy(by).applyInPandas(run, schema)
