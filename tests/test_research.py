"""Walk-forward tests, allocation, corporate actions and the relational source against plain versions."""

from __future__ import annotations

import datetime
import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.operators import actions, allocation, walkforward
from tidemark.plans import q_research
from tidemark.sources import relational

SF = f"{DATA}/sf0.001"


# ---- allocation


def water(scores, caps, budget):
    """min(cap, k score) by bisection on k."""
    s, c = np.array(scores, float), np.array(caps, float)
    c = np.where(s > 0, c, 0)
    if c.sum() <= budget:
        return c
    lo, hi = 0.0, 1e9
    for _ in range(200):
        k = (lo + hi) / 2
        lo, hi = (k, hi) if np.minimum(c, k * s).sum() < budget else (lo, k)
    return np.minimum(c, lo * s)


def twin(rows, limits):
    """rows of one portfolio: (name, side, sector, score)."""
    out, cap = {}, {}
    budget = {"long": (limits.gross + limits.net) / 2, "short": (limits.gross - limits.net) / 2}
    parts = defaultdict(list)
    for r in rows:
        parts[r[1], r[2]].append(r)
    for part in parts.values():
        cap |= dict(zip([r[0] for r in part], water([r[3] or 0 for r in part], [limits.name] * len(part), limits.sector), strict=True))
    if limits.neutral:
        sectors = sorted({r[2] for r in rows})
        room = [min(sum(cap[r[0]] for r in parts[side, s]) for side in budget) for s in sectors]
        share = water([sum(max(r[3] or 0, 0) for r in rows if r[2] == s) for s in sectors], room, limits.gross / 2)
        for s, b in zip(sectors, share, strict=True):
            for side in budget:
                part = parts[side, s]
                out |= dict(zip([r[0] for r in part], water([r[3] or 0 for r in part], [cap[r[0]] for r in part], b), strict=True))
    else:
        for side, b in budget.items():
            part = [r for r in rows if r[1] == side]
            out |= dict(zip([r[0] for r in part], water([r[3] or 0 for r in part], [cap[r[0]] for r in part], b), strict=True))
    return {r[0]: out[r[0]] * (1 if r[1] == "long" else -1) for r in rows}


@pytest.mark.parametrize("limits", [
    allocation.Limits(1.0, 1.0, 0.1, 0.3), allocation.Limits(1.2, 0.4, 0.15, 0.3), allocation.Limits(1.0, 0.0, 0.2, 0.25, True), allocation.Limits(2.0, 0.0, 0.05, 0.1), allocation.Limits(1.0, 1.0, 1.0, 1.0),
])
def test_weights_are_those_of_bisection_and_break_no_limit(spark, limits):
    rng = np.random.default_rng(7)
    rows = []
    for book in range(12):
        for i in range(int(rng.integers(1, 40))):
            score = None if rng.random() < 0.05 else float(rng.choice([0.0, 1.0, 1.0, rng.random() * 10 ** rng.integers(0, 4)]))
            rows.append((book, f"n{i:02}", "long" if limits.net == limits.gross or rng.random() < 0.5 else "short", f"s{rng.integers(0, 4)}", score))
    w = allocation.nested_weights(spark.createDataFrame(rows, "book int, name string, side string, sector string, score double"), ["book"], "name", "sector", "score", limits)
    got = {(r["book"], r["name"]): r["weight"] for r in w.collect()}
    for book in range(12):
        for name, v in twin([r[1:] for r in rows if r[0] == book], limits).items():
            assert got[book, name] == pytest.approx(v, abs=1e-9)
    assert [tuple(r)[1:] for r in allocation.violations(w, ["book"], "sector", limits).collect()] == [(0, 0, 0, 0)] * 12


def test_limits_that_contradict_each_other():
    with pytest.raises(ValueError, match="gross"):
        allocation.Limits(1.0, 1.5)
    with pytest.raises(ValueError, match="neutral"):
        allocation.Limits(1.0, 0.5, neutral=True)


# ---- walk-forward


def test_windows_of_a_short_history(spark):
    day = datetime.date(2020, 1, 1)
    days = [("x", i, day + datetime.timedelta(7 * i)) for i in range(40)] + [("y", i, day + datetime.timedelta(30 * i)) for i in range(40)]
    w = walkforward.year_windows(spark.createDataFrame(days, "e string, idx long, d date"), ["e"], 1, 1, 3).orderBy("e", "window").collect()
    # x has no day after its first year; y has tests in 2021, 2022 and the start of 2023
    assert [(r["e"], r["window"]) for r in w] == [("y", 0), ("y", 1), ("y", 2)]
    assert [(r["train_lo"], r["train_hi"], r["test_lo"]) for r in w] == [(0, 9, 13), (13, 21, 25), (25, 33, 37)] and w[-1]["test_hi"] == 39
    anchored = walkforward.year_windows(spark.createDataFrame(days, "e string, idx long, d date"), ["e"], 1, 1, 50, anchored=True).orderBy("window").collect()
    assert [r["train_lo"] for r in anchored] == [None] * 3 and [r["test_lo"] for r in anchored] == [13, 25, 37]


def test_picks_by_neighbours_and_reasons_of_gaps(spark):
    scores = spark.createDataFrame([("x", 0, 1, 1, 5.0), ("x", 0, 3, 3, 1.0), ("x", 0, 4, 4, 2.0), ("x", 0, 4, 3, 2.0), ("x", 0, 9, 1, 2.5)], "e string, window int, a int, b int, score double")
    windows = spark.createDataFrame([("x", 0, 0, 3, 4, 6), ("x", 1, 1, 4, 7, 9)], "e string, window int, train_lo long, train_hi long, test_lo long, test_hi long")
    by_mean = walkforward.pick_cells(scores, windows, ["e"], ["a", "b"])
    assert [(r["a"], r["b"], r["value"]) for r in by_mean.orderBy("window").collect()] == [(1, 1, 5.0), (None, None, None)]
    values = {(r["a"], r["b"]): r["value"] for r in walkforward.neighbor_scores(scores, ["e", "window"], ["a", "b"]).collect()}
    assert values == {(1, 1): 5.0, (3, 3): 2.0, (4, 4): 1.5, (4, 3): 1.5, (9, 1): 2.5}
    returns = spark.createDataFrame([("x", 1, 1, i, 0.1 * (i % 3)) for i in range(10)], "e string, a int, b int, idx long, ret double")
    curve = walkforward.stitch(returns, by_mean, ["e"], ["a", "b"])
    assert [(r["idx"], r["ret"], round(r["equity"], 6)) for r in curve.orderBy("idx").collect()] == [(4, None, 1.0), (5, 0.2, 1.2), (6, 0.0, 1.2)]
    assert walkforward.retention(curve, by_mean, ["e"]).first()["gap"] == "no_cell"
    good = by_mean.where("window = 0")
    assert walkforward.retention(curve, good, ["e"]).first()["retention"] == pytest.approx(0.1 / math.sqrt(0.02) / 5)
    assert walkforward.retention(curve.where("idx = 4"), good, ["e"]).first()["gap"] == "out_of_sample_unavailable"
    bad = good.selectExpr("e", "window", "a", "b", "-score AS score", "test_lo", "test_hi")
    assert walkforward.retention(curve, bad, ["e"]).first()["gap"] == "non_positive_train"


# ---- corporate actions


def plain(events, prices, rules):
    """The rules for one security, action by action."""
    prices = sorted(prices)
    found = {}
    for (_, close, _, shares, volume), (i, _, base, now, _) in itertools.pairwise(prices):
        r, s = base / close, now / shares
        if abs(r - 1) > rules.jump:
            found[i] = (r, s if abs(s - 1) > rules.shares else None, volume == 0)
    tol = lambda f: max(rules.relative * abs(min(f, 1 / f) - 1), rules.absolute)

    def nearest(lo, hi, at, f):
        c = [(abs(found[j][0] / f - 1), abs(j - at), j) for j in found if lo <= j <= hi and abs(found[j][0] / f - 1) <= tol(f)]
        return min(c) if c else None

    units, rest, out = [], [], {}
    for e, at, ratio in events:
        if ratio is None or ratio <= 0 or ratio == 1:
            out[e] = (at, at, "unmatched", "no_share_change" if ratio == 1 else "ratio_null", False, 1.0, 1.0, None)
            continue
        f = 1 / ratio
        if hit := nearest(at, at, at, f):
            units.append((hit, "nominal", [(e, at, f)]))
        elif abs(min(f, 1 / f) - 1) > rules.absolute:
            if hit := nearest(at - rules.lookback, at + rules.window, at, f):
                units.append((hit, "price_matched", [(e, at, f)]))
            else:
                rest.append((at, e, f))
        else:
            out[e] = (at, at, "unmatched", "no_price_match", False, 1.0, 1.0, None)
    runs = []
    for at, e, f in sorted(rest):
        if runs and at - runs[-1][-1][1] <= rules.window:
            runs[-1].append((e, at, f))
        else:
            runs.append([(e, at, f)])
    for run in runs:
        first = min(a for _, a, _ in run)
        hit = nearest(first - rules.lookback, max(a for _, a, _ in run) + rules.window, first, math.prod(f for _, _, f in run)) if len(run) > 1 else None
        if hit:
            units.append((hit, "price_matched_combined", sorted(run)))
        else:
            for e, at, _ in run:
                out[e] = (at, at, "unmatched", "no_price_match", False, 1.0, 1.0, None)
    owner = {}
    for (fit, far, j), basis, run in sorted(units, key=lambda u: (u[0][0], u[0][1], min(u[2])[0])):
        owns = owner.setdefault(j, min(run)[0]) == min(run)[0]
        r, s, _ = found[j]
        s = 1 / r if s is None else s
        sound = abs(r * s - 1) <= rules.product
        for n, (e, at, f) in enumerate(run):
            if not owns:
                out[e] = (at, at, basis, "same_day_suppressed", False, 1.0, 1.0, None)
                continue
            others = math.prod(x for k, (_, _, x) in enumerate(run) if k)
            pf, sf = (f, 1 / f) if n else (r / others, s * others)
            out[e] = (at, j, basis, "factor", True, pf, sf, None) if sound else (at, j, basis, "base_inconsistent", False, 1.0, 1.0, None if n else r)
    rows = [(e, *v) for e, v in out.items()]
    for j, (r, s, quiet) in found.items():
        if j in owner or (s is None and quiet):
            continue
        ok = s is not None and abs(r * s - 1) <= rules.product
        kind = "unknown_price_only" if s is None else "unknown_base" if ok else "base_inconsistent"
        rows.append((None, j, j, "jump", kind, ok, r if ok else 1.0, s if ok else 1.0, None if ok else r))
    return rows


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


def test_actions_one_by_one(spark):
    events, prices = q_research.market_with_actions(spark, SF)
    got = actions.resolve(events, prices, ["sid"], "idx", q_research.RULES).collect()
    by_sid = defaultdict(lambda: ([], []))
    for r in events.collect():
        by_sid[r["sid"]][0].append((r["event_id"], r["nominal_idx"], r["ratio"]))
    for r in prices.collect():
        by_sid[r["sid"]][1].append((r["idx"], r["close"], r["base"], r["shares"], r["volume"]))
    want = [(sid, *row) for sid, (e, p) in by_sid.items() for row in plain(e, p, q_research.RULES)]
    assert sorted(map(repr, map(rounded, map(tuple, got)))) == sorted(map(repr, map(rounded, want)))
    kinds = {(r["basis"], r["resolution"]) for r in got}
    assert {b for b, _ in kinds} == {"nominal", "price_matched", "price_matched_combined", "jump", "unmatched"}
    assert {"factor", "ratio_null", "no_share_change", "no_price_match", "unknown_price_only"} <= {x for _, x in kinds}


def test_a_jump_has_one_owner_and_gives_one_price_only_factor(spark):
    prices = [("s", 0, 100.0, 100.0, 1e6, 5.0), ("s", 1, 51.0, 50.0, 1e6, 5.0), ("s", 2, 50.0, 51.0, 3e6, 5.0), ("s", 3, 24.0, 25.0, 9e6, 5.0)]
    events = [("s", "a", 1, 2.0), ("s", "b", 0, 2.1), ("s", "c", 3, 2.0)]
    p = spark.createDataFrame(prices, "sid string, idx long, close double, base double, shares double, volume double")
    got = {r["event_id"]: r for r in actions.resolve(spark.createDataFrame(events, "sid string, event_id string, nominal_idx long, ratio double"), p, ["sid"], "idx", q_research.RULES).collect()}
    assert got["a"]["resolution"] == "factor" and got["a"]["price_factor"] == 0.5 and got["a"]["share_factor"] == 2.0
    assert got["b"]["resolution"] == "same_day_suppressed" and got["b"]["apply_idx"] == 0
    assert got["c"]["resolution"] == "base_inconsistent" and got["c"]["price_only_factor"] == 0.5 and got["c"]["price_factor"] == 1.0


# ---- a relational store


def test_filters_reach_the_store_and_parts_are_read_apart(spark):
    rows = relational.stored_bars(spark, q_research.store(spark, SF), "bars", q_research.DERBY, datetime.date(2024, 1, 5), datetime.date(2024, 1, 20), 4)
    asked = rows.where("symbol = '3'")
    assert asked.rdd.getNumPartitions() == 4
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(symbol,3)" in plan.replace("*", "") and "GreaterThanOrEqual(session" in plan.replace("*", "")
    with pytest.raises(ValueError, match="identifier"):
        relational.stored_bars(spark, "jdbc:derby:memory:x", "bars; DROP", q_research.DERBY)


def test_rows_that_cannot_be_read_and_prices_that_contradict(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("ok", day, 1.0, 2.0, 0.5, 1.5, "7"), ("text", day, 1.0, 2.0, 0.5, 1.5, "7"), ("text", day, 1.0, 2.0, 0.5, 1.5, "n/a"), ("nan", day, math.nan, 2.0, 0.5, 1.5, "7"), ("odd", day, 3.0, 2.0, 0.5, 1.5, "7")]
    d = spark.createDataFrame(rows, "symbol string, session date, open double, high double, low double, close double, volume string")
    asked = spark.createDataFrame([(s,) for s in ("ok", "text", "nan", "odd", "none", "ok")], "symbol string")
    bars, report = relational.read_bars_jdbc(asked, d)
    assert {r["symbol"]: r["status"] for r in report.collect()} == {"ok": "ok", "text": "format_error", "nan": "format_error", "odd": "ok", "none": "no_data"}
    assert {(r["symbol"], r["high"], r["volume"]) for r in bars.collect()} == {("ok", 2.0, 7), ("odd", 3.0, 7)}
    bars, report = relational.read_bars_jdbc(asked, d, "strict")
    assert report.where("symbol = 'odd'").first()["status"] == "rejected" and bars.count() == 1
