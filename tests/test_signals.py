"""Signals, states, zones and regimes against plain loops over each security."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators import signals, technical
from tidemark.plans.q_shapes import PERIODS as P

N = 160


@pytest.fixture(scope="module")
def market():
    rng = np.random.default_rng(12)
    out = {}
    for sid in range(6):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, N) + 0.02 * np.sin(np.arange(N) / 9)))
        open_ = close * (1 + rng.normal(0, 0.01, N))
        high = np.maximum(open_, close) * (1 + rng.random(N) * 0.02)
        low = np.minimum(open_, close) * (1 - rng.random(N) * 0.02)
        out[sid] = dict(open=open_, high=high, low=low, close=close, volume=rng.integers(1, 50, N).astype(float))
    return out


@pytest.fixture(scope="module")
def frame(spark, market):
    rows = [(s, i, *(float(b[c][i]) for c in ("open", "high", "low", "close", "volume"))) for s, b in market.items() for i in range(N)]
    return spark.createDataFrame(rows, "sid int, n long, open double, high double, low double, close double, volume double").cache()


@pytest.fixture(scope="module")
def swings(frame):
    return technical.zigzag(frame.select("sid", "n", "high", "low", "close"), "sid", "n", P.strength, 2.0).cache()


def ema(x, n, alpha=None):
    alpha = alpha or 2 / (n + 1)
    lead = next(i for i, v in enumerate(x) if not math.isnan(v))
    out = [math.nan] * len(x)
    out[lead + n - 1] = sum(x[lead : lead + n]) / n
    for i in range(lead + n, len(x)):
        out[i] = out[i - 1] + alpha * (x[i] - out[i - 1])
    return out


def roll(f, x, n, back=0):
    out = []
    for i in range(len(x)):
        w = x[i - back - n + 1 : i - back + 1] if i - back - n + 1 >= 0 else []
        out.append(f(w) if len(w) == n and not any(math.isnan(v) for v in w) else math.nan)
    return out


def plain(b, swing):
    """Events and states of one security, bar by bar."""
    c, h, lo, v = (b[k].tolist() for k in ("close", "high", "low", "volume"))
    mean = lambda w: sum(w) / len(w)
    ch = [math.nan] + [c[i] - c[i - 1] for i in range(1, N)]
    gain, fall = (ema([math.nan] + [max(s * x, 0) for x in ch[1:]], P.strength, 1 / P.strength) for s in (1, -1))
    rsi = [math.nan if math.isnan(g) else 100.0 if f == 0 else g / (g + f) * 100 for g, f in zip(gain, fall, strict=True)]
    macd = [x - y for x, y in zip(ema(c, P.fast), ema(c, P.slow), strict=True)]
    sig = ema(macd, P.signal)
    obv = [0.0]
    for i in range(1, N):
        obv.append(obv[-1] + (c[i] > c[i - 1]) * v[i] - (c[i] < c[i - 1]) * v[i])
    half = lambda n, back=0: [(x + y) / 2 for x, y in zip(roll(max, h, n, back), roll(min, lo, n, back), strict=True)]
    a, k, z = P.cloud
    span_a = [(x + y) / 2 for x, y in zip(half(a, k), half(k, k), strict=True)]
    top = [math.nan if math.isnan(x) or math.isnan(y) else max(x, y) for x, y in zip(span_a, half(z, k), strict=True)]
    n, sk, sd = P.stochastic
    raw = [(c[i] - y) / (x - y) * 100 for i, (x, y) in enumerate(zip(roll(max, h, n), roll(min, lo, n), strict=True))]
    kk = roll(mean, raw, sk)
    dd = roll(mean, kk, sd)
    mid = roll(mean, c, P.short)
    dev = roll(lambda w: math.sqrt(mean([(x - mean(w)) ** 2 for x in w])), c, P.short)
    es, em, sm, sl = ema(c, P.short), ema(c, P.middle), roll(mean, c, P.middle), roll(mean, c, P.long)
    poc, above = [math.nan] * N, [math.nan] * N
    for i in range(P.profile - 1, N):
        s = range(i - P.profile + 1, i + 1)
        x0, x1 = min(lo[j] for j in s), max(h[j] for j in s)
        step, bins = (x1 - x0) / P.bins, [0.0] * P.bins
        for j in s:
            for q in range(P.bins):
                bins[q] += v[j] * max(0.0, min(h[j], x0 + (q + 1) * step) - max(lo[j], x0 + q * step)) / (h[j] - lo[j])
        centre = [x0 + (q + 0.5) * step for q in range(P.bins)]
        if i + 1 < N:
            poc[i + 1] = centre[bins.index(max(bins))]
        above[i] = sum(x for x, y in zip(bins, centre, strict=True) if y > c[i]) / sum(bins)
    last = {}
    for kind in ("high", "low"):
        last[kind] = [next((p for _, p in sorted(((cf, ix), p) for ix, kd, p, cf in swing if kd == kind and cf <= i)[::-1]), math.nan) for i in range(N)]
    cond = {
        "A1": [(x, x < 30) for x in rsi], "A2": [(x, x > 70) for x in rsi], "A3": [(x + y, x > y) for x, y in zip(macd, sig, strict=True)], "A4": [(x + y, x < y) for x, y in zip(macd, sig, strict=True)],
        "A5": [(t, x > t) for x, t in zip(c, top, strict=True)], "A6": [(x + y, x > y) for x, y in zip(half(a), half(k), strict=True)],
        "A7": [(x + y, o > x and q <= y) for o, q, x, y in zip(obv, c, roll(max, obv, P.short, 1), roll(max, c, P.short, 1), strict=True)],
        "A8": [(m + d, x < m - 2 * d) for x, m, d in zip(c, mid, dev, strict=True)], "A9": [(m + d, x > m + 2 * d) for x, m, d in zip(c, mid, dev, strict=True)],
        "A10": [(x + y, x > y) for x, y in zip(kk, dd, strict=True)], "A11": [(x + y, x > y) for x, y in zip(es, em, strict=True)], "A12": [(x + y, x > y) for x, y in zip(sm, sl, strict=True)], "A13": [(q, x > q) for x, q in zip(c, poc, strict=True)],
    }
    ev = set()
    for name, xs in cond.items():
        for i in range(1, N):
            if not math.isnan(xs[i][0]) and not math.isnan(xs[i - 1][0]) and xs[i][1] and not xs[i - 1][1] and (name != "A10" or dd[i] < 20):
                ev.add((i, name))
    for i in range(1, N):
        if c[i] > last["high"][i - 1] and c[i - 1] <= last["high"][i - 1]:
            ev.add((i, "A14"))
        if c[i] < last["low"][i - 1] and c[i - 1] >= last["low"][i - 1]:
            ev.add((i, "A15"))
    om = roll(mean, obv, P.short)
    st = []
    for i in range(N):
        row = [
            (es[i], c[i] > es[i]), (es[i] + em[i], es[i] > em[i]), (sl[i], c[i] > sl[i]), (macd[i] + sig[i], macd[i] > sig[i]), (top[i], c[i] > top[i]), (rsi[i], 40 <= rsi[i] <= 70), (om[i], obv[i] > om[i]),
            (mid[i] + dev[i], mid[i] < c[i] <= mid[i] + 2 * dev[i]), (kk[i] + dd[i], dd[i] < kk[i] < 80), (above[i], above[i] < 0.3),
        ]
        st.append([None if math.isnan(x) else t for x, t in row])
    return ev, st


def test_signals_and_states(frame, swings, market):
    of = defaultdict(list)
    for r in swings.collect():
        of[r["sid"]].append((r["n"], r["kind"], r["price"], r["confirmed"]))
    m = signals.with_last_swings(signals.measured(frame, "sid", "n", P), swings, "sid", "n").cache()
    got = defaultdict(set)
    for r in signals.events(m, "sid", "n").collect():
        got[r["sid"]].add((r["n"], r["signal"]))
    states = {(r["sid"], r["n"]): r for r in signals.states(m, "sid", "n").collect()}
    seen = set()
    for sid, b in market.items():
        ev, st = plain(b, of[sid])
        assert got[sid] == ev
        seen |= {s for _, s in ev}
        for i, row in enumerate(st):
            r = states[sid, i]
            assert [r[f"D{k}"] for k in range(1, 11)] == row
            assert r["D11"] == (None if None in row else sum(row))
    assert len(seen) >= 14


def test_zones_and_how_they_were_tested(frame, swings, market):
    atr = technical.recursive_indicators(frame, "sid", "n", P.strength).select("sid", "n", "atr")
    b = frame.join(atr, ["sid", "n"]).where("atr IS NOT NULL")
    got = defaultdict(list)
    for r in signals.tested_zones(swings.where(f"n >= {P.strength}").select("sid", "n", "price", "confirmed"), b, "sid", "n", 1.5).collect():
        got[r["sid"]].append((round(r["lo"], 6), round(r["hi"], 6), r["touches"], r["formed"], r["held"], r["broken"]))
    rows = defaultdict(list)
    for r in b.orderBy("n").collect():
        rows[r["sid"]].append(r)
    piv = defaultdict(list)
    for r in swings.where(f"n >= {P.strength}").collect():
        piv[r["sid"]].append((r["price"], r["n"], r["confirmed"]))
    total = 0
    for sid, bars in rows.items():
        tol = [1.5 * r["atr"] / r["close"] for r in bars]
        at = {r["n"]: i for i, r in enumerate(bars)}
        groups = []
        for p in sorted(piv[sid]):
            if groups and math.log(p[0] / groups[-1][0][0]) <= tol[-1]:
                groups[-1].append(p)
            else:
                groups.append([p])
        want = []
        for g in groups:
            ns = sorted(p[1] for p in g)
            touches = 1 + sum(y - x > signals.TOUCH_GAP for x, y in zip(ns, ns[1:], strict=False))
            if touches < 2:
                continue
            lo, hi = g[0][0], g[-1][0]
            t = at[max(p[2] for p in g)]
            while math.log(hi / lo) > tol[t]:
                t += 1
            formed, held, broken = bars[t]["n"], 0, 0
            side = [1 if r["close"] > hi else -1 if r["close"] < lo else 0 for r in bars]
            meets = [r["low"] <= hi and r["high"] >= lo for r in bars]
            t += 1
            while t < len(bars):
                if not meets[t]:
                    t += 1
                    continue
                e = t
                while e + 1 < len(bars) and meets[e + 1]:
                    e += 1
                if e + 1 < len(bars) and side[t - 1]:
                    held += side[e + 1] == side[t - 1]
                    broken += side[e + 1] == -side[t - 1]
                t = e + 2
            want.append((round(lo, 6), round(hi, 6), touches, formed, held, broken))
        assert sorted(got[sid]) == sorted(want)
        total += sum(w[4] + w[5] for w in want)
    assert total > 5


def test_major_swings(frame, swings, market):
    got = {(r["sid"], r["n"], r["kind"]): r["major"] for r in signals.significant(swings, frame, "sid", "n", 8).collect()}
    for r in swings.collect():
        b, i = market[r["sid"]], r["n"]
        around = [j for j in range(i - 8, i + 9) if j != i]
        whole = around[0] >= 0 and around[-1] < N
        ok = whole and all(b["high"][j] <= r["price"] if r["kind"] == "high" else b["low"][j] >= r["price"] for j in around)
        assert got[r["sid"], i, r["kind"]] == ok
    assert 0 < sum(got.values()) < len(got)


def test_regime_verdicts(spark):
    base = lambda s, f, n=60: [(s, i, f(i) * 1.01, f(i) * 0.99, f(i), 1.0) for i in range(n)]
    wave = lambda i: 100 + 3 * math.sin(i)
    rows = base("rise", lambda i: 100 * 1.01**i * (1 + 0.03 * math.sin(i))) + base("box", wave) + base("few", wave, 10) + base("still", lambda i: 5.0) + base("fall", lambda i: 100 * 0.98**i * (1 + 0.03 * math.sin(i)))
    b = spark.createDataFrame(rows, "sid string, n long, high double, low double, close double, atr double")
    sw = [("rise", 10, "high", 100.0, 12, True), ("rise", 20, "high", 120.0, 22, True), ("rise", 5, "low", 90.0, 7, True), ("rise", 15, "low", 95.0, 17, True), ("rise", 30, "low", 50.0, 32, False), ("fall", 10, "high", 1.0, 12, True), ("fall", 20, "high", 2.0, 70, True)]
    s = spark.createDataFrame(sw, "sid string, n long, kind string, price double, confirmed long, major boolean")
    got = {r["sid"]: (r["structure"], r["verdict"], r["reason"]) for r in signals.regimes(b, s, "sid", "n", 60).collect()}
    assert got["rise"] == ("up", "up", None)
    assert got["fall"] == ("insufficient", "hold", "structure_mismatch")
    assert got["box"][1] in ("box", "unclear") and got["few"] == ("insufficient", "undecidable", "too_few_bars") and got["still"] == ("insufficient", "undecidable", "degenerate")
