"""Fans of lines against every line taken one by one."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators import fans

RULES = fans.Rules(least_gap=10, least_bars=20, most_bars=90, recent=4, moves=7, seed=3)


def plain_turns(close, high, low, size, base, span, rules):
    """Touches and their ends, line by line and day by day."""
    turned = pierced = 0
    d, days = 1, len(close)
    lines = range(-400, 401)
    while d < days:
        a, before = size[d - 1], close[d - 1]
        if any(math.isnan(v) for v in (a, before, low[d], high[d])):
            d += 1
            continue
        tol = rules.touch * a
        value = {k: base[d] + k * span for k in lines}
        down = [k for k in lines if before > value[k] + tol and low[d] <= value[k] + tol]
        up = [k for k in lines if before < value[k] - tol and high[d] >= value[k] - tol]
        if not down and not up:
            d += 1
            continue
        if down and up:
            side = 1 if value[min(up)] - before >= before - value[max(down)] else -1
        else:
            side = 1 if down else -1
        k = max(down) if side == 1 else min(up)
        end = None
        for i in range(d, min(d + rules.horizon, days)):
            way = side * (close[i] - base[i] - k * span)
            if abs(way) >= rules.move * a:
                end, back = i, way > 0
                break
        if end is None:
            if d + rules.horizon > days:
                break
            d += rules.horizon
            continue
        turned, pierced = turned + back, pierced + (not back)
        d = end + 1
    return turned, pierced


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(21)
    out = {}
    for sid in range(5):
        n = 140
        close = 100 + np.cumsum(rng.normal(0, 1, n)) + 8 * np.sin(np.arange(n) / 7)
        high, low = close + rng.random(n) * 1.5, close - rng.random(n) * 1.5
        swings = [(int(i), "low" if k else "high", float(low[i] if k else high[i])) for i, k in zip(range(6, n - 25, 9), itertools.cycle((True, False)))]
        out[sid] = close, high, low, np.full(n, 1.4), swings
    return out


def test_touches_of_moved_fans(walks):
    rng = np.random.default_rng(1)
    for close, high, low, size, _ in walks.values():
        size = size.copy()
        size[:3] = np.nan
        for _ in range(12):
            base, span = 95 + rng.normal(0, 0.1) * np.arange(len(close)) + rng.random(), rng.uniform(1.5, 9)
            got = fans.turns(close, high, low, size, base[None], np.array([span]), RULES)[0]
            assert tuple(got) == plain_turns(close, high, low, size, base, span, RULES)


def test_scores_and_ranks(spark, walks):
    bars = [(s, i, float(h[i]), float(lo[i]), float(c[i]), float(a[i])) for s, (c, h, lo, a, _) in walks.items() for i in range(len(c))]
    swings = [(s, *x) for s, w in walks.items() for x in w[4]]
    d = fans.fan_scores(spark.createDataFrame(swings, "sid int, n long, kind string, price double"), spark.createDataFrame(bars, "sid int, n long, high double, low double, close double, atr double"), "sid", "n", RULES)
    got = defaultdict(list)
    for r in d.orderBy("sid", "direction", "rank").collect():
        got[r["sid"], r["direction"]].append((r["xa"], r["xb"], r["xc"], r["turns"], r["pierces"], round(r["score"], 9), round(r["p"], 9)))
    some = 0
    for sid, (c, h, lo, a, sw) in walks.items():
        for direction, foot, s in (("up", "low", 1), ("down", "high", -1)):
            feet, tops = [x for x in sw if x[1] == foot][-4:], [x for x in sw if x[1] != foot][-4:]
            want = []
            for (xa, _, ya), (xb, _, yb) in itertools.combinations(feet, 2):
                slope = (yb - ya) / (xb - xa)
                for xc, _, yc in tops:
                    width = yc - ya - slope * (xc - xa)
                    if xb - xa < 10 or s * slope <= 0 or xc <= xa or s * width <= 0 or abs(0.5 * width) < 1.4 or len(c) - 1 - xc < 20:
                        continue
                    begin = max(xc + 1, len(c) - 90) - 1
                    span = abs(0.5 * width)
                    base = ya + slope * (np.arange(begin, len(c)) - xa)
                    run = lambda u: plain_turns(c[begin:], h[begin:], lo[begin:], a[begin:], base + u, span, RULES)  # noqa: E731, B023
                    real = run(0.0)
                    null = np.array([run(u)[0] for u in np.random.default_rng(3).uniform(0, span, 7)])
                    score = (real[0] - null.mean()) / max(null.std(), 1)
                    want.append(((-score, -xc, xa, xb), (xa, xb, xc, *real, round(score, 9), round((1 + (null >= real[0]).sum()) / 8, 9))))
            want = [v for _, v in sorted(want)[:3]]
            assert got[sid, direction] == want
            some += len(want)
    assert some >= 8
