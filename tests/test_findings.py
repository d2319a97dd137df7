"""Faults that a review found: zero prices, ties, forests too large for one recursion."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions

from tests.conftest import DATA
from tidemark.functions import series
from tidemark.operators import allocation, market, reports, signals, stats, technical
from tidemark.plans import q_forms, q_shapes, q_stats
from tidemark.sources import forms
from tidemark.streaming import streams


def test_flows_with_a_value_of_nothing(spark):
    d = spark.createDataFrame([(1, 0, 10.0, 0.0), (1, 1, 20.0, 2.0), (1, 2, 0.0, 3.0), (1, 3, 5.0, 1.0)], "sid int, idx int, s double, n double")
    got = [(r["flow"], r["opened"]) for r in market.etf_flows(d, "sid", "idx", "s", "n").orderBy("idx").collect()]
    assert got == [(None, True), (20.0, False), (-60.0, False), (5.0, False)]


def test_roots_beyond_the_recursion_limit(spark):
    n = 120_000  # 1.3 million rows of a recursion, which stops at a million
    e = spark.range(10, n).selectExpr("id AS child", "id div 3 AS parent")
    got = {r["node"]: r["root"] for r in stats.lineage_root(spark, e).collect()}
    assert len(got) == n - 10
    for x in range(10, n, 997):
        root = x
        while root > 9:
            root //= 3
        assert got[x] == root


def test_roots_of_a_deep_chain_and_of_a_circle(spark):
    got = {r["node"]: r["root"] for r in stats.lineage_root(spark, spark.range(1, 100).selectExpr("id AS child", "id - 1 AS parent")).collect()}
    assert got == {i: 0 for i in range(1, 100)}
    with pytest.raises(ValueError, match="circle"):
        stats.lineage_root(spark, spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "child int, parent int"))


def test_scenarios_with_closes_of_nothing(spark):
    w = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "book int, sym int, weight double")
    closes = spark.createDataFrame([(1, "2024-01-01", 4.0), (1, "2024-01-05", 0.0), (2, "2024-01-01", 0.0), (2, "2024-01-05", 3.0)], "sym int, d string, close double").selectExpr("sym", "date(d) d", "close")
    index = spark.sql("SELECT date'2024-01-01' d, 10.0D close UNION ALL SELECT date'2024-01-05', 11.0D")
    betas = spark.createDataFrame([(1, 1.0), (2, 2.0)], "sym int, beta double")
    r = reports.scenarios(w, closes, index, betas, [("w", "2024-01-01", "2024-01-05")], "book", "sym").where("scenario = 'w'").first()
    assert (r["lines"], r["proxies"]) == (2, 1) and r["portfolio"] == pytest.approx(0.5 * -1 + 0.5 * 2 * 0.1)


def test_odds_count_a_fall_to_nothing(spark):
    d = spark.createDataFrame([(i, t, float(i), p) for i in range(10) for t, p in enumerate((2.0, 3.0 if i else 0.0, 4.0))], "sid int, idx int, score double, close double")
    got = {r["decile"]: r for r in market.decile_odds(d, "sid", "idx", "score", "close", 1, d.idx >= 2).collect()}
    # security 0 falls to nothing, and has no return from there
    assert sum(r["n"] for r in got.values()) == 19 and got[1]["mean"] == pytest.approx((-1 + 1 / 3) / 2)


def test_days_and_average_ranges_need_one_shuffle(spark):
    b = q_shapes.numbered_bars(spark, f"{DATA}/sf0.001")
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    atr = technical.recursive_indicators(b.drop("atr"), "sid", "n").select("sid", "n", "atr")
    assert b.select("sid", "n", "atr").exceptAll(atr).count() == 0 and b.where("atr IS NOT NULL").count() > 0


@pytest.mark.parametrize("page", ["<table id=a><TR><td colspan=2>1 &amp; 2<td>b</table>", "<title>a<p>b</title><p>c", "<p>x < y</p><h1>t", "<script><p></script><h2>t</h2>", "<title>t</title><table><th rowspan=\"2\">h"])
def test_pages_are_cut_as_the_library_cuts_them(page):
    class Told(forms.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.told = []

        def handle_starttag(self, tag, attrs):
            self.told.append(("start", tag, attrs))

        def handle_endtag(self, tag):
            self.told.append(("end", tag))

        def handle_data(self, data):
            self.told.append(("data", data))

    one, other = Told(), Told()
    forms.read_page(one, page)
    other.feed(page)
    other.close()
    assert one.told == other.told


def test_rows_of_pages_come_in_small_frames(spark, monkeypatch):
    monkeypatch.setattr(forms, "PAGES_AT_ONCE", 3)
    pages = spark.range(0, 20, 1, 1).selectExpr("id", "concat('<table><tr><td>', id, '</td></tr></table>') html")
    assert sorted(int(r["cells"][0]) for r in forms.grids(pages, "id", "html").collect()) == list(range(20))


@pytest.mark.parametrize("limits", [allocation.Limits(1.2, 0.4, 0.15, 0.3), allocation.Limits(1.0, 0.0, 0.15, 0.2, True)])
def test_shares_sum_no_frame_anew_for_each_row(spark, limits):
    d = spark.createDataFrame([(0, 1, "a", "long", 2.0), (0, 2, "a", "short", 1.0)], "d int, sid int, sector string, side string, score double")
    plan = allocation.nested_weights(d, ["d"], "sid", "sector", "score", limits)._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "unboundedpreceding$(), currentrow$()" in plan


def test_bodies_are_opened_once(spark):
    blobs = spark.createDataFrame([(1, "main", b"x"), (1, "side", b"y")], "sid int, endpoint string, body binary")
    rows, rejects = forms.monthly_consensus(blobs, ["sid"], "endpoint", "body", "main", "side")
    opened = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [inflate(")
    assert opened(rejects) == 1 and opened(rows) == 2  # of each endpoint its own
    assert sorted(tuple(r) for r in rejects.collect()) == [(1, "main", "not_compressed_text"), (1, "side", "not_compressed_text")] and rows.count() == 0


def test_a_summary_reads_its_pages_once(spark):
    table = lambda name, *rows: f"<table id={name}>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    note = ["최근 3개월 이내에 제시된 의견이 없습니다"]
    p = spark.createDataFrame([(1, table("a", "12345", "98765") + table("b", note)), (2, table("a", ["4", "1,000", "-", "1", ""]) + table("b", note)), (3, table("b", note)), (4, "")], "id int, html string")
    d = forms.analyst_summary(p, forms.grids(p, "id", "html"), "id", "html", "a", "b")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {r["id"]: (r["opinion_score"], r["target_price"], r["analyst_count"], r["status"]) for r in d.collect()}
    assert got == {1: (9.0, 8.0, 5, "ok"), 2: (4.0, 1000.0, 0, "ok"), 3: (None, None, None, "failed"), 4: (None, None, None, "failed")}


def test_profiles_of_all_windows_are_those_of_each(monkeypatch):
    monkeypatch.setattr(signals, "CELLS_AT_ONCE", 700)
    rng = np.random.default_rng(5)
    low = np.round(rng.random(300) * 4 + 1, 1)
    high = low + np.round(rng.random(300), 1) * (rng.random(300) < 0.7)
    low[100:140] = high[100:140] = 2.0
    close, volume = (high + low) / 2, rng.integers(0, 50, 300).astype(float)
    best, above = signals.profiles(high, low, close, volume, 20, 8)
    assert np.isnan(best[:19]).all() and np.isnan(above[:19]).all()
    for i in range(19, 300):
        edges, v = signals.profile(high[i - 19 : i + 1], low[i - 19 : i + 1], volume[i - 19 : i + 1], 8)
        middle = (edges[:-1] + edges[1:]) / 2
        assert v[np.abs(middle - best[i]).argmin()] == pytest.approx(v.max()) and np.abs(middle - best[i]).min() < 1e-12
        assert above[i] == pytest.approx(v[middle > close[i]].sum() / v.sum())
    assert [len(x) for x in signals.profiles(high[:5], low[:5], close[:5], volume[:5], 20, 8)] == [5, 5]


def test_swings_on_their_bars_are_those_of_the_zigzag(spark):
    b, pivots = q_shapes.marked_bars(spark, f"{DATA}/sf0.001")
    numbered = q_shapes.numbered_bars(spark, f"{DATA}/sf0.001")
    both = lambda x, y: x.exceptAll(y).count() + y.exceptAll(x).count()
    assert pivots.count() > 0 and both(pivots, q_shapes.swings(numbered)) == 0 and both(b.select(*numbered.columns), numbered) == 0
    plan = pivots._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroups") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_levels_and_folds_over_batches_are_those_of_one_pass(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 600
    rows = [(int(a), int(t), float(e), str(p)) for a, t, e, p in zip(rng.integers(0, 5, n), rng.integers(0, 4000, n), rng.integers(20, 140, n), rng.choice(["x", "y"], n), strict=True)]
    rows.sort(key=lambda r: r[1] + rng.integers(0, 300))  # up to five minutes out of order
    schema = "k int, t timestamp, e double, p string"
    write = lambda part: spark.createDataFrame(part, "k int, s int, e double, p string").selectExpr("k", "timestamp_seconds(s) t", "e", "p").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    levels = streams.stream_drawdown(f"file://{tmp_path}/q", "k", "t", "e", (0.1, 0.3, 0.5), 0.05, "10 minutes")
    folded = streams.stream_fold_consecutive(f"file://{tmp_path}/f", "k", "t", "p", "10 minutes")
    for part in (rows[:250], rows[250:], [(9, 0, 1.0, "x")], [(9, 100_000, 1.0, "x")]):  # the third is late, the last moves the watermark past all
        write(part)
        for q in (levels, folded):
            q.run(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))

    def level(values):
        peak, before, halted, reducing = float("-inf"), 0.0, False, False
        for e in values:
            peak = max(peak, e)
            loss = 1 - e / peak
            halted = halted or (before < 0.5 <= loss)
            reducing = loss >= 0.3 or (reducing and loss >= 0.05)
            before = loss
            yield 3 if halted else 2 if reducing else int(loss >= 0.1)

    want, kept = [], []
    for k in range(5):
        own = sorted((t, e) for a, t, e, _ in rows if a == k)
        want += [(k, t, x) for (t, _), x in zip(own, level([e for _, e in own]), strict=True)]
        own = sorted((t, p) for a, t, _, p in rows if a == k)
        kept += [(k, *r) for r, before in zip(own, [(0, None), *own], strict=False) if r[1] != before[1]]
    got = lambda q, c: sorted(tuple(r) for r in q.rows(spark).selectExpr("k", "int(unix_seconds(t))", c).collect())
    assert got(levels, "level") == sorted(want) and got(folded, "p") == sorted(kept)
    last = len(list((tmp_path / "q" / "out").glob("batch=*"))) - 1
    assert last == 3 and len(list((tmp_path / "q" / "states").glob("batch=*"))) == 3
    levels(spark.read.schema(schema).parquet(f"file://{tmp_path}/in").where("k = 9 AND unix_seconds(t) > 0"), last)
    assert got(levels, "level") == sorted(want)  # the batch run again


def test_weekly_returns_hold_no_table_of_days_or_weeks(spark):
    plan = q_stats.e20_weekly(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "HashAggregate" not in plan


def test_weekly_returns_of_gaps_and_days_unknown(spark):
    days = [(1, "2024-01-03", 2.0), (1, "2024-01-05", 3.0), (1, "2024-01-08", 6.0), (1, "2024-01-24", None), (1, "2024-01-30", 4.0), (1, "2024-01-31", 5.0), (2, None, 7.0), (2, "2024-01-07", 1.0), (2, "2024-01-08", 4.0)]
    d = spark.createDataFrame(days, "sid int, d string, e double").selectExpr("sid", "date(d) d", "e")
    got = {(r["sid"], str(r["week"])): (r["ret"], r["sessions"]) for r in stats.weekly_returns(d, ["sid"], "d", "e").collect()}
    assert got == {(1, "2024-01-01"): (0.5, 2), (1, "2024-01-08"): (1.0, 1), (1, "2024-01-22"): (None, 1), (1, "2024-01-29"): (0.25, 2), (2, "None"): (None, 1), (2, "2024-01-01"): (0.0, 1), (2, "2024-01-08"): (3.0, 1)}


def test_rows_of_a_form_stay_with_their_page(spark):
    plan = q_forms.s14_prelim(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # a join sent the cells of all pages to the driver
    page = "<table></table><table><tr><td>a<td>b</table><p>c<table><tr><td colspan=2>d<table><tr><td>e</table></table>"
    got = forms.nested_grids(spark.createDataFrame([(1, page), (2, ""), (3, None)], "id int, html string"), "id", "html")
    assert {r["id"]: r["tables"] for r in got.collect()} == {1: [[["a", "b"]], [["d", "d"]], [["e"]]], 2: [], 3: []}


@pytest.mark.parametrize("query", [q_shapes.t11_signals, q_shapes.t11_states])
def test_signals_and_states_need_one_shuffle(spark, query):
    plan = query(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Union" not in plan


def test_swings_and_bars_before_of_one_group_are_those_of_joins_and_windows(spark):
    rng = np.random.default_rng(7)
    rows = []
    for sid in range(4):
        close = 50 + np.cumsum(rng.integers(-2, 3, 120)) / 2  # prices that are often equal
        high, low = close + rng.integers(0, 3, 120) / 2, close - rng.integers(0, 3, 120) / 2
        for i in range(120 if sid < 3 else 4):
            gone = sid == 2 and i in (0, 30, 31, 77)
            rows.append((sid, i, float(close[i]), None if gone else float(high[i]), float(low[i]), None if gone and i > 30 else float(close[i]), float(rng.integers(1, 9))))
    b = spark.createDataFrame(rows, "sid int, n long, open double, high double, low double, close double, volume double").cache()
    p = q_shapes.PERIODS
    one = signals.measured(b, "sid", "n", p, (14, 2.0), before=True).cache()
    joined = signals.with_last_swings(signals.measured(b, "sid", "n", p), technical.zigzag(b, "sid", "n", 14, 2.0), "sid", "n").cache()
    same = one.select(*joined.columns)
    assert same.exceptAll(joined).count() == joined.exceptAll(same).count() == 0 and one.where("last_high IS NOT NULL AND last_low IS NOT NULL").count() > 100
    got, want = signals.events(one, "sid", "n"), signals.events(joined, "sid", "n")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.select("signal").distinct().count() >= 14


def test_measures_of_fixed_windows_are_those_of_windows(spark):
    rng = np.random.default_rng(3)
    some = lambda x: None if rng.random() < 0.02 else float(x)
    rows = [(sid, i, 1.0, some(9 + rng.random()), some(8 - rng.random()), some(8 + rng.random()), some(rng.integers(1, 9))) for sid in range(5) for i in range(1 if sid == 4 else 90)]
    b = spark.createDataFrame(rows, "sid int, n long, open double, high double, low double, close double, volume double").cache()
    p = q_shapes.PERIODS
    close = functions.col("close")
    want = technical.obv(b, ["sid"], "n").select(
        "sid", "n", "obv", series.ts_mean(["sid"], "n", close, p.long).alias("sma_long"), series.ts_std(["sid"], "n", close, p.short).alias("sd_short"), series.ts_max(["sid"], "n", close, p.short, 1).alias("close_top"),
        ((series.ts_max(["sid"], "n", functions.col("high"), p.cloud[0]) + series.ts_min(["sid"], "n", functions.col("low"), p.cloud[0])) / 2).alias("conversion"),
    )
    m = signals.measured(b, "sid", "n", p)
    got = m.select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.where("sma_long IS NOT NULL").count() > 20
    assert m.columns == signals.measured(b, "sid", "n", p).columns  # the bars' own columns stay as they are
