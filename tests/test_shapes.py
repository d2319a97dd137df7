"""Chart shapes, channels and drawdown levels against plain loops; streams that are run again."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.operators import market, shapes
from tidemark.plans import q_shapes
from tidemark.streaming import streams

SF = f"{DATA}/sf0.001"
ONE = {"H1": (5, False), "H2": (5, True), "H3": (3, False), "H4": (3, True), "H5": (4, True), "H6": (5, True)}


def near(a, b):
    return abs(a - b) / ((a + b) / 2) <= 0.04


def line_of(shape, xs, es, kinds):
    """(x0, y0, x1, y1) if the swings make the shape."""
    hi = kinds[0] == "high"
    if shape in ("H1", "H2"):
        if hi != (shape == "H1"):
            return None
        s = 1 if hi else -1
        e1, e2, e3, e4, e5 = (s * e for e in es)
        head = e3 - (e2 + e4) / 2
        if e3 > e1 and e3 > e5 and near(es[0], es[4]) and near(es[1], es[3]) and head > 0 and 0.25 <= ((e1 - e2) + (e5 - e4)) / 2 / head <= 0.7 and head / es[2] >= 0.03:
            return xs[1], es[1], xs[3], es[3]
    if shape in ("H3", "H4") and hi == (shape == "H3"):
        top = (es[0] + es[2]) / 2
        if xs[2] - xs[0] > 22 and near(es[0], es[2]) and (top - es[1]) / top * (1 if hi else -1) >= 0.03:
            return 0, es[1], 1, es[1]
    if shape == "H5":
        h = [e for e, k in zip(es, kinds, strict=True) if k == "high"]
        lo = [e for e, k in zip(es, kinds, strict=True) if k == "low"]
        if near(*h) and near(*lo) and 0.05 <= sum(h) / sum(lo) - 1 <= 0.3:
            return 0, max(h), 1, max(h)
    if shape == "H6" and hi and es[0] > es[2] > es[4] and es[1] < es[3]:
        return xs[2], es[2], xs[4], es[4]
    return None


def plain_shapes(pivots, close):
    out = []
    for i in range(len(pivots)):
        for shape, (n, up) in ONE.items():
            p = pivots[i : i + n]
            line = line_of(shape, [x[0] for x in p], [x[2] for x in p], [x[1] for x in p]) if len(p) == n else None
            if not line:
                continue
            stop = min(p[-1][0] + 20, p[0][0] + 63, max(close), pivots[i + n][3] - 1 if i + n < len(pivots) else math.inf)
            for t in range(p[-1][3], int(stop) + 1):
                level = line[1] + (line[3] - line[1]) * (t - line[0]) / (line[2] - line[0])
                if t in close and (close[t] > level if up else close[t] < level):
                    out.append((shape, t, p[0][0], p[-1][0], round(level, 6)))
                    break
    return sorted(out)


def swing_frame(spark, rows):
    return spark.createDataFrame(rows, "sid int, n long, kind string, price double, confirmed long")


def bar_frame(spark, rows):
    return spark.createDataFrame(rows, "sid int, n long, close double")


MADE = {
    "H1": ([100, 90, 115, 91, 101], "high", 80.0), "H2": ([100, 112, 85, 111, 99], "low", 130.0), "H3": ([100, 90, 101], "high", 80.0), "H4": ([100, 110, 101], "low", 120.0),
    "H5": ([100, 90, 101, 91], "high", 130.0), "H6": ([120, 90, 110, 95, 100], "high", 130.0),
}


@pytest.mark.parametrize("shape", MADE)
def test_a_made_example_of_each_shape(spark, shape):
    prices, first, close = MADE[shape]
    gap = 12
    kinds = itertools.cycle(["high", "low"] if first == "high" else ["low", "high"])
    rows = [(1, gap * i, k, float(p), gap * i + 3) for i, (p, k) in enumerate(zip(prices, kinds, strict=False))]
    calm = 85.0 if shape == "H6" else (prices[-1] + prices[-2]) / 2
    end = rows[-1][1]
    bars = [(1, t, close if t >= end + 6 else calm) for t in range(end + 15)]
    got = [(r["shape"], r["complete"]) for r in shapes.swing_shapes(swing_frame(spark, rows), bar_frame(spark, bars), "sid", "n").collect()]
    assert (shape, end + 6) in got
    late = [(1, t, close if t >= end + 21 else calm) for t in range(end + 30)]
    assert shape not in [r["shape"] for r in shapes.swing_shapes(swing_frame(spark, rows), bar_frame(spark, late), "sid", "n").collect()]


def test_shapes_of_random_swings(spark):
    rng = np.random.default_rng(11)
    pivots, bars = defaultdict(list), {}
    for sid in range(60):
        t, high = 0, rng.random() < 0.5
        for _ in range(30):
            t += int(rng.integers(3, 16))
            pivots[sid].append((t, "high" if high else "low", float(rng.choice([100, 101, 103, 104, 108, 112, 90, 88, 91, 85]) + (6 if high else -6)), t + int(rng.integers(1, 4))))
            high = not high
        bars[sid] = {i: float(rng.uniform(80, 122)) for i in range(t + 10) if rng.random() < 0.97}
    rows = [(s, *p) for s, ps in pivots.items() for p in ps]
    got = defaultdict(list)
    for r in shapes.swing_shapes(swing_frame(spark, rows), bar_frame(spark, [(s, i, c) for s, b in bars.items() for i, c in b.items()]), "sid", "n").collect():
        got[r["sid"]].append((r["shape"], r["complete"], r["first"], r["last"], round(r["level"], 6)))
    for sid in pivots:
        assert sorted(got[sid]) == plain_shapes(pivots[sid], bars[sid])
    assert {x[0] for v in got.values() for x in v} == set(ONE)


def plain_flags(high, low, close):
    hits = {}
    for p in range(10, len(close)):
        base = min(close[p - 10 : p])
        if close[p] / base - 1 < 0.15:
            continue
        for m in range(5, 16):
            t, flag = p + m + 1, range(p + 1, p + m + 1)
            if t >= len(close) or any(high[i] > high[p] or low[i] < close[p] - 0.5 * (close[p] - base) for i in flag):
                break
            if close[t] > max(high[i] for i in flag):
                hits.setdefault(t, (p, round(max(high[i] for i in flag), 6)))
                break
    return sorted((t, *v) for t, v in hits.items())


def test_flags(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for sid in range(40):
        x = 100 * np.exp(np.cumsum(rng.normal(0.004, 0.02, 150) + (rng.random(150) < 0.03) * 0.16))
        high, low = x * (1 + rng.random(150) * 0.004), x * (1 - rng.random(150) * 0.004)
        rows += [(sid, i, float(high[i]), float(low[i]), float(x[i])) for i in range(150)]
        want[sid] = plain_flags(high, low, x)
    got = defaultdict(list)
    for r in shapes.flags(spark.createDataFrame(rows, "sid int, n long, high double, low double, close double"), "sid", "n").collect():
        got[r["sid"]].append((r["complete"], r["first"], round(r["level"], 6)))
    assert sum(map(len, want.values())) > 5
    assert all(sorted(got[s]) == want[s] for s in want)


def test_candles_and_gaps(spark):
    bars = [(1, i, 10.0 - i, 10.2 - i, 8.8 - i, 9.0 - i, 1.0) for i in range(6)]
    bars += [(1, 6, 3.5, 6.2, 3.4, 6.1, 1.0), (1, 7, 7.0, 7.5, 6.9, 7.2, 1.0), (1, 8, 5.0, 5.5, 4.0, 4.2, None), (1, 9, 4.0, 9.0, 4.0, 9.0, 1.0)]
    d = spark.createDataFrame(bars, "sid int, n long, open double, high double, low double, close double, atr double")
    got = {(r["shape"], r["complete"]) for r in shapes.candle_shapes(d, "sid", "n").collect()}
    assert {x for x in got if x[1] >= 6} == {("C1", 6), ("C2", 6), ("G1", 7), ("G2", 8)}


def test_supports_are_the_lines_without_a_low_below(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40):
        for _ in range(30):
            x = np.sort(rng.choice(500, n, replace=False)).astype(float)
            y = rng.integers(0, 60, n).astype(float)
            got = shapes.supports(x, y)
            assert got[-1] == -1
            for i in range(n - 1):
                slopes = (y[i + 1 :] - y[i]) / (x[i + 1 :] - x[i])
                assert (y[got[i]] - y[i]) / (x[got[i]] - x[i]) == slopes.min()


def test_channels_against_all_pairs(spark):
    b = q_shapes.numbered_bars(spark, SF)
    p = q_shapes.swings(b).select("sid", "n", "kind", "price")
    got = defaultdict(list)
    for r in shapes.trend_channels(p, b, "sid", "n", 3).orderBy("sid", "direction", "rank").collect():
        got[r["sid"], r["direction"]].append((r["x1"], r["x2"], r["width_at"], r["outside"], r["span"], round(r["width_atr"], 9)))
    pivots, bars = defaultdict(list), defaultdict(list)
    for r in p.collect():
        pivots[r["sid"]].append((r["n"], r["price"], r["kind"]))
    for r in b.orderBy("sid", "n").collect():
        bars[r["sid"]].append((r["n"], r["close"], r["atr"]))
    seen = 0
    for sid, own in bars.items():
        for direction, base, s in (("up", "low", 1), ("down", "high", -1)):
            pts = sorted((x, s * y) for x, y, k in pivots[sid] if k == base)
            far = [(x, s * y) for x, y, k in pivots[sid] if k != base]
            unit, out = own[-1][2], []
            for (xa, ya), (xb, yb) in itertools.combinations(pts, 2):
                k = (yb - ya) / (xb - xa)
                if not yb - ya >= unit or any(y < ya + k * (x - xa) - 1e-9 for x, y in pts if x >= xa):
                    continue
                gaps = [(y - ya - k * (x - xa), x) for x, y in far if x > xa]
                gap, at = max(gaps, key=lambda g: (g[0], -g[1]), default=(0, 0))
                if gap <= 0:
                    continue
                over = [s * c - ya - k * (x - xa) for x, c, _ in own if x >= xa]
                outside = sum(o < 0 or o > gap for o in over)
                span = own[-1][0] - xa + 1
                out.append(((span < 20, outside / span, gap / unit, xa), (xa, xb, at, outside, span, round(gap / unit, 9))))
            want = [v for _, v in sorted(out)[:3]]
            assert got[sid, direction] == want
            seen += len(want)
    assert seen > 10


def plain_levels(rows, limits, recover):
    """The rule day by day: rows are (kind or None, value)."""
    top, halted, reducing, loss, out = -math.inf, False, False, 0.0, []
    for kind, v in rows:
        if kind == "reset":
            top, halted, reducing, loss = v, False, False, 0.0
        elif kind == "resume":
            reducing, halted = reducing or halted, False
        else:
            top, was = max(top, v), loss
            loss = 1 - v / top
            if was < limits[2] <= loss:
                halted = True
            if loss >= limits[1]:
                reducing = True
            elif loss < recover and not halted:
                reducing = False
            out.append(3 if halted else 2 if reducing else int(loss >= limits[0]))
    return out


def test_drawdown_levels_with_actions(spark):
    rng = np.random.default_rng(9)
    closes, actions, want = [], [], {}
    for account in range(80):
        e, rows = 100.0, []
        for day in range(60):
            e = max(1.0, e * (1 + rng.normal(0, 0.06)))
            closes.append((account, day, e))
            rows.append((None, e))
            if rng.random() < 0.08:
                kind = "reset" if rng.random() < 0.4 else "resume"
                actions.append((account, day, kind, e if kind == "reset" else None))
                rows.append((kind, e))
        want[account] = plain_levels(rows, (0.05, 0.1, 0.2), 0.04)
    c = spark.createDataFrame(closes, "account int, d int, equity double")
    a = spark.createDataFrame(actions, "account int, d int, kind string, peak double")
    got = defaultdict(list)
    for r in market.drawdown_state(c, "account", "d", "equity", (0.05, 0.1, 0.2), 0.04, a).orderBy("account", "d").collect():
        got[r["account"]].append(r["level"])
    assert got == want
    assert {x for v in want.values() for x in v} == {0, 1, 2, 3}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    q = streams.Quarantine(f"file://{tmp_path}/q", "k", "t", "2 DAYS", keep=2)
    day = "2024-01-{:02} 00:00:00".format
    batch = lambda *rows: spark.createDataFrame([(k, day(d), d) for k, d in rows], "k string, t string, v int").withColumn("t", spark_timestamp())

    def spark_timestamp():
        from pyspark.sql import functions as F

        return F.col("t").cast("timestamp")

    batches = [batch(("a", 5), ("b", 1)), batch(("a", 2), ("a", 3), ("b", 9), ("c", 1)), batch(("b", 6), ("b", 7), ("a", 9)), batch(("a", 6), ("c", 1))]
    for i, b in enumerate(batches):
        q(b, i)
    rows = lambda: sorted((r["batch"], r["k"], r["v"], r["late"]) for r in q.rows(spark).collect())
    first = rows()
    assert [r[1:3] for r in first if r[3]] == [("a", 2), ("b", 6), ("a", 6)]
    q(batches[3], 3)
    assert rows() == first and len(first) == 11
    assert sorted(p.name for p in (tmp_path / "q" / "high").iterdir() if p.is_dir()) == ["batch=2", "batch=3"]
