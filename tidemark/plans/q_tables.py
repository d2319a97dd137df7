"""Warehouse tables, stock models and data quality."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import models, quality, versions, warehouse

from . import views
from .q_market import _RET, returns
from .q_time import _TWO, _two_sources, raw, two_builds
from .registry import query

C = F.col


def rnd(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else C(c) for c in df.columns])


@query("d01_trading_calendar", "SELECT d, idx, prev_d, next_d FROM calendar", "calendar")
def d01(spark, sf):
    return views.calendar(views.bars(spark, sf))


@query("d02_security_span", """, r AS (SELECT sid, idx, idx - row_number() OVER (PARTITION BY sid ORDER BY idx) AS run FROM panel), s AS (SELECT sid, min(idx) AS first, max(idx) AS last, count(*) AS n FROM r GROUP BY sid, run)
    SELECT sid, first, last, n, row_number() OVER w AS span_seq, CASE WHEN lead(first) OVER w IS NOT NULL THEN 'coverage_gap' WHEN last < (SELECT max(idx) FROM panel) THEN 'delisted' END AS end_reason FROM s WINDOW w AS (PARTITION BY sid ORDER BY first)""", "panel")
def d02(spark, sf):
    p = views.panel(spark, sf)
    last = p.agg(F.max("idx")).first()[0]
    return warehouse.security_span(p, ["sid"], "idx", last if last is not None else -1)


@query("d03_security_master", "SELECT s_suppkey AS sid, min(CAST(l_shipdate AS DATE)) AS listed, max(CAST(l_shipdate AS DATE)) AS last_seen, CASE WHEN s_acctbal > 5000 THEN 'common' WHEN s_acctbal > 0 THEN 'preferred' ELSE 'other' END AS type FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal")
def d03(spark, sf):
    from tidemark.functions.clean import classify

    spans = warehouse.ticker_spans(views.long_bars(spark, sf)).select("sid", C("first").alias("listed"), C("last").alias("last_seen"))
    s = views.read(spark, sf, "supplier").select(C("s_suppkey").alias("sid"), classify([("common", C("s_acctbal") > 5000), ("preferred", C("s_acctbal") > 0)], "other").alias("type"))
    return s.join(spans, "sid", "left").select("sid", "listed", "last_seen", "type")


@query("d04_price_daily", "SELECT sid, d, close, round(close * volume, 6) AS cap, round(coalesce(lag(close) OVER (PARTITION BY sid ORDER BY d), open), 6) AS base, CASE WHEN volume > 1 THEN 'trade' ELSE 'reference' END AS kind, d AS available_date FROM bars", "bars")
def d04(spark, sf):
    w = Window.partitionBy("sid").orderBy("d")
    return rnd(views.bars(spark, sf).select("sid", "d", "close", (C("close") * C("volume")).alias("cap"), F.coalesce(F.lag("close").over(w), "open").alias("base"), F.when(C("volume") > 1, "trade").otherwise("reference").alias("kind"), C("d").alias("available_date")), "cap", "base")


@query("d05_universe_daily", """, a AS (SELECT *, max(CASE WHEN (sid + idx) % 13 = 0 THEN idx END) OVER w AS h, max(CASE WHEN (sid + idx) % 13 = 3 THEN idx END) OVER w AS r, max(CASE WHEN volume >= 2 THEN idx END) OVER w AS lt, min(idx) OVER (PARTITION BY sid) - 1 AS f, CASE WHEN count(amount) OVER b = 5 THEN avg(amount) OVER b END AS adv FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY sid ORDER BY idx ROWS 4 PRECEDING)),
    s AS (SELECT sid, idx, adv, idx - coalesce(lt, f) AS no_trade_run, CASE WHEN coalesce(h > coalesce(r, -1), false) THEN 'halted' WHEN idx - coalesce(lt, f) > 0 THEN 'no_trade' WHEN NOT coalesce(adv > 20, false) THEN 'illiquid' ELSE 'normal' END AS status FROM a)
    SELECT sid, idx, status, no_trade_run, CASE WHEN adv IS NOT NULL AND status = 'normal' THEN round(cume_dist() OVER (PARTITION BY idx, adv IS NOT NULL AND status = 'normal' ORDER BY adv), 6) END AS liquidity_rank FROM s""", "panel")
def d05(spark, sf):
    k = F.pmod(C("sid") + C("idx"), F.lit(13))
    u = warehouse.universe_daily(views.panel(spark, sf), ["sid"], "idx", k == 0, k == 3, C("volume") >= 2, C("adv") > 20, "amount", 5)
    return rnd(u.select("sid", "idx", "status", "no_trade_run", "liquidity_rank"), "liquidity_rank")


@query("d07_detect_splits", ", l AS (SELECT sid, idx, CAST(volume AS DOUBLE) / lag(volume) OVER w AS ratio, close / nullif(lag(close) OVER w, 0) AS move FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx)) SELECT sid, idx, round(ratio, 6) AS ratio FROM l WHERE (ratio >= 1.5 OR ratio <= 1 / 1.5) AND move * ratio BETWEEN 0.5 AND 2", "panel")
def d07(spark, sf):
    p = views.panel(spark, sf).withColumn("close", F.nullif("close", F.lit(0.0)))
    return rnd(warehouse.detect_splits(p, ["sid"], "idx", "volume", "close").select("sid", "idx", "ratio"), "ratio")


_F = ", f AS (SELECT sid, idx, 1.0 + idx % 4 AS factor FROM panel WHERE (sid + idx) % 7 = 0)"


def factors(spark, sf):
    return views.panel(spark, sf).where(F.pmod(C("sid") + C("idx"), F.lit(7)) == 0).select("sid", "idx", (1.0 + C("idx") % 4).alias("factor"))


@query("d08_adj_factor", None)
def d08(spark, sf):
    p = views.panel(spark, sf).withColumn("close", F.nullif("close", F.lit(0.0)))
    jumps = p.select("sid", "idx", F.try_divide(F.lag("close").over(Window.partitionBy("sid").orderBy("idx")), C("close")).alias("ratio")).where("ratio IS NOT NULL")
    events = factors(spark, sf).withColumnRenamed("factor", "ratio")
    return warehouse.adj_factor(events, jumps, ["sid"], "idx", 5, 0.3)


@query("d09_price_adj_forward", _F + " SELECT p.sid, p.idx, round(p.close * coalesce(product(f.factor), 1), 6) AS adj FROM panel p LEFT JOIN f ON f.sid = p.sid AND f.idx <= p.idx GROUP BY p.sid, p.idx, p.close", "panel")
def d09(spark, sf):
    p = views.panel(spark, sf).select("sid", "idx", "close")
    return rnd(warehouse.adjusted_forward(p, factors(spark, sf), ["sid"], "idx", "close").select("sid", "idx", "adj"), "adj")


@query("d10_price_adj_asof", _F + ", g AS (SELECT p.sid, p.idx, product(f.factor) AS k FROM panel p JOIN f ON f.sid = p.sid WHERE f.idx > p.idx AND f.idx <= 20 GROUP BY p.sid, p.idx) SELECT p.sid, p.idx, round(p.close / coalesce(g.k, 1), 6) AS adj FROM panel p LEFT JOIN g ON g.sid = p.sid AND g.idx = p.idx WHERE p.idx < 21", "panel")
def d10(spark, sf):
    p = views.panel(spark, sf).select("sid", "idx", "close")
    return rnd(warehouse.adjusted_as_of(p, factors(spark, sf), ["sid"], "idx", "close", 20).select("sid", "idx", "adj"), "adj")


@query("d11_adj_close_masked", _F + " SELECT p.sid, p.idx, CASE WHEN f.sid IS NULL THEN p.close END AS close FROM panel p LEFT JOIN f USING (sid, idx)", "panel")
def d11(spark, sf):
    f = factors(spark, sf).select("sid", "idx", F.lit(True).alias("m"))
    return views.panel(spark, sf).join(f, ["sid", "idx"], "left").select("sid", "idx", F.when(C("m").isNull(), C("close")).alias("close"))


@query("d12_firm_mktcap", "SELECT d, sid % 8 AS firm, round(sum(close * volume), 6) AS cap, count(*) AS classes FROM panel GROUP BY ALL", "panel")
def d12(spark, sf):
    return views.panel(spark, sf).groupBy("d", (C("sid") % 8).alias("firm")).agg(F.round(F.sum(C("close") * C("volume")), 6).alias("cap"), F.count("*").alias("classes"))


@query("d13_short_daily", """, g AS (SELECT s.sid, c.d, c.idx FROM (SELECT DISTINCT sid FROM bars) s CROSS JOIN calendar c) SELECT g.sid, g.idx, CASE WHEN b.close IS NOT NULL THEN 'measured' WHEN g.idx >= 10 THEN 'src_omitted' WHEN g.sid % 2 = 0 THEN 'empty_response' ELSE 'not_collected' END AS kind FROM g LEFT JOIN bars b USING (sid, d)""", "calendar")
def d13(spark, sf):
    b = views.bars(spark, sf)
    grid = b.select("sid").distinct().withColumn("k", F.lit(1)).join(F.broadcast(views.calendar(b).select("d", "idx").withColumn("k", F.lit(1))), "k")
    j = grid.join(b.select("sid", "d", "close"), ["sid", "d"], "left")
    return j.select("sid", "idx", warehouse.cell_kind(C("close"), C("idx") >= 10, C("sid") % 2 == 0)["kind"].alias("kind"))


@query("d14_credit_daily", ", v AS (SELECT *, row_number() OVER (PARTITION BY sid, d ORDER BY seq) AS i FROM versions) SELECT sid, d, seq, CASE WHEN i > 1 THEN 'version_folded' WHEN value > 300000 THEN 'over_limit' END AS reject_reason FROM v", "versions")
def d14(spark, sf):
    v = versions.fold_with_rejects(views.versions(spark, sf), ["sid", "d"], ["seq"])
    return v.select("sid", "d", "seq", F.coalesce("reject_reason", F.when(C("value") > 300000, "over_limit")).alias("reject_reason"))


@query("d15_flow_daily", "SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS d, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS r, round(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 4) AS a, round(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 4) AS n FROM lineitem GROUP BY ALL")
def d15(spark, sf):
    g = views.read(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("sid"), C("l_shipdate").cast("date").alias("d"))
    w = g.pivot("l_returnflag", ["R", "A", "N"]).agg(F.round(F.sum("l_extendedprice"), 4))
    return w.select("sid", "d", C("R").alias("r"), C("A").alias("a"), C("N").alias("n"))


@query("d16_consensus_asof", _TWO + ", r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY m DESC, available, src, value) AS i FROM s WHERE available <= DATE '1997-06-30') SELECT sid, m, src, value FROM r WHERE i = 1", "versions")
def d16(spark, sf):
    known = _two_sources(spark, sf).where(C("available") <= F.lit(datetime.date(1997, 6, 30)))
    return versions.first_version(known, ["sid"], [F.desc("m"), "available", "src", "value"]).select("sid", "m", "src", "value")


@query("d17_consensus_sessions", ", o AS (SELECT DISTINCT sid, d FROM long_bars), c AS (SELECT d FROM (SELECT DISTINCT d FROM long_bars) WHERE day(d) % 5 = 0) SELECT o.sid, o.d, c.d AS session FROM o ASOF LEFT JOIN c ON o.d >= c.d", "long_bars")
def d17(spark, sf):
    b = views.long_bars(spark, sf)
    cal = views.calendar(b.where(F.dayofmonth("d") % 5 == 0))
    return warehouse.snap_to_session(b.select("sid", "d").distinct(), cal, "d").select("sid", "d", "session")


@query("d18_opinion_daily", "SELECT d, payload, count(*) AS n, count(DISTINCT sid) AS names, round(avg(value), 4) AS mean FROM versions GROUP BY ALL", "versions")
def d18(spark, sf):
    return views.versions(spark, sf).groupBy("d", "payload").agg(F.count("*").alias("n"), F.countDistinct("sid").alias("names"), F.round(F.avg("value"), 4).alias("mean"))


@query("d20_disclosure_version", """, v AS (SELECT *, payload = 'P' AS c, last_day(d) AS e FROM versions), w AS (SELECT sid, d, seq, c, e, last(CASE WHEN NOT c THEN seq END IGNORE NULLS) OVER x AS o FROM v WINDOW x AS (PARTITION BY sid ORDER BY d, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, CASE WHEN c THEN 'correction' ELSE 'original' END AS kind, CASE WHEN c THEN o END AS original, greatest(0, date_diff('day', e - 25, d)) AS delay_days FROM w""", "versions")
def d20(spark, sf):
    v = views.versions(spark, sf).withColumn("end", F.last_day("d"))
    return warehouse.disclosure_version(v, ["sid"], "d", "seq", C("payload") == "P", "end", -25).select("seq", "kind", "original", "delay_days")


@query("d21_holder_daily", ", u AS (SELECT sid, d, seq, 'large' AS src FROM versions WHERE value > 200000 UNION ALL SELECT sid, d, seq, 'insider' FROM versions WHERE payload = 'F'), r AS (SELECT *, row_number() OVER (PARTITION BY sid, d ORDER BY src, seq) AS i, count(*) OVER (PARTITION BY sid, d) AS n_src_rows FROM u) SELECT sid, d, seq, src, n_src_rows FROM r WHERE i = 1", "versions")
def d21(spark, sf):
    v = views.versions(spark, sf).select("sid", "d", "seq", "payload", "value")
    u = v.where("value > 200000").withColumn("src", F.lit("large")).unionByName(v.where("payload = 'F'").withColumn("src", F.lit("insider")))
    return versions.first_version(u, ["sid", "d"], ["src", "seq"]).select("sid", "d", "seq", "src", "n_src_rows")


@query("d22_shares_dividends", "SELECT sid, year(d) AS y, max(value) FILTER (payload = 'F') AS final, arg_max(value, seq) AS latest FROM versions GROUP BY ALL", "versions")
def d22(spark, sf):
    return views.versions(spark, sf).groupBy("sid", F.year("d").alias("y")).agg(F.max(F.when(C("payload") == "F", C("value"))).alias("final"), F.max_by("value", "seq").alias("latest"))


@query("d23_fin_prelim", "SELECT sid, q, CASE WHEN month(q) = 1 THEN 'not_quarter' WHEN q > DATE '2000-01-01' THEN 'future_period' WHEN n = 1 THEN 'no_disclosure' ELSE 'ok' END AS status FROM fundamentals", "fundamentals")
def d23(spark, sf):
    from tidemark.functions.clean import classify

    rules = [("not_quarter", F.month("q") == 1), ("future_period", C("q") > F.lit(datetime.date(2000, 1, 1))), ("no_disclosure", C("n") == 1)]
    return views.fundamentals(spark, sf).select("sid", "q", classify(rules, "ok").alias("status"))


@query("d24_fin_latest", """, k AS (SELECT *, year(q) * 4 + quarter(q) AS qi FROM fundamentals WHERE available_date <= DATE '1999-12-31') SELECT sid, q, round(CASE WHEN count(revenue) OVER w = 4 AND qi - min(qi) OVER w = 3 THEN sum(revenue) OVER w END, 4) AS ttm, round(CASE WHEN lag(qi) OVER o = qi - 1 THEN revenue - lag(revenue) OVER o END, 4) AS change FROM k WINDOW w AS (PARTITION BY sid ORDER BY qi ROWS 3 PRECEDING), o AS (PARTITION BY sid ORDER BY qi)""", "fundamentals")
def d24(spark, sf):
    f = warehouse.latest_financials(views.fundamentals(spark, sf), ["sid"], "q", "available_date", "revenue", datetime.date(1999, 12, 31))
    return rnd(f.select("sid", "q", "ttm", "change"), "ttm", "change", places=4)


@query("d25_fin_ratio", "SELECT sid, q, metric, round(value, 6) AS value FROM (SELECT sid, q, revenue / n AS per_order, CAST(n AS DOUBLE) AS orders FROM fundamentals) UNPIVOT (value FOR metric IN (per_order, orders))", "fundamentals")
def d25(spark, sf):
    f = views.fundamentals(spark, sf).select("sid", "q", (C("revenue") / C("n")).alias("per_order"), C("n").cast("double").alias("orders"))
    return rnd(f.unpivot(["sid", "q"], ["per_order", "orders"], "metric", "value").where("value IS NOT NULL"), "value")


@query("d26_sector_asof", ", r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY q DESC) AS i FROM fundamentals WHERE q <= DATE '1998-06-30') SELECT sid, q, date_diff('day', q, DATE '1998-06-30') AS age_days FROM r WHERE i = 1", "fundamentals")
def d26(spark, sf):
    return warehouse.snapshot_as_of(views.fundamentals(spark, sf), ["sid"], "q", datetime.date(1998, 6, 30)).select("sid", "q", "age_days")


@query("d27_index_daily", "SELECT d, round(avg(close), 6) AS close, d + 1 AS available_date FROM bars GROUP BY d", "bars")
def d27(spark, sf):
    return views.bars(spark, sf).groupBy("d").agg(F.round(F.avg("close"), 6).alias("close")).withColumn("available_date", F.date_add("d", 1))


@query("d28_dataset_profile", ", x AS (SELECT d, close, CASE WHEN sid % 3 = 0 THEN amount END AS amount FROM bars) SELECT 'close' AS field, min(d) AS first, max(d) AS last, count(close) AS covered, 1.0 AS share FROM x UNION ALL SELECT 'amount', min(d) FILTER (amount IS NOT NULL), max(d) FILTER (amount IS NOT NULL), count(amount), round(count(amount) / count(*), 6) FROM x", "bars")
def d28(spark, sf):
    x = views.bars(spark, sf).select("d", "close", F.when(C("sid") % 3 == 0, C("amount")).alias("amount"))
    return rnd(warehouse.dataset_profile(x, "d", ["close", "amount"], {}).drop("unit"), "share")


@query("d28_factor_readiness", ", x AS (SELECT count(*) FILTER (sid % 3 = 0) / count(*) AS s FROM bars) SELECT 'value' AS factor, s >= 0.5 AS ready, CASE WHEN s < 0.5 THEN 'amount' ELSE '' END AS blocked FROM x UNION ALL SELECT 'price', true, '' FROM x", "bars")
def d28b(spark, sf):
    x = views.bars(spark, sf).select("d", "close", F.when(C("sid") % 3 == 0, C("amount")).alias("amount"))
    return warehouse.factor_readiness(warehouse.dataset_profile(x, "d", ["close", "amount"], {}), {"value": ["close", "amount"], "price": ["close"]}, 0.5)


@query("d29_raw_panel", ", f AS (SELECT sid, available_date AS d, max(n) AS n FROM fundamentals GROUP BY ALL) SELECT b.sid, b.d, x.close AS lagged, f.n FROM panel b LEFT JOIN panel x ON x.sid = b.sid AND x.idx = b.idx - 1 ASOF LEFT JOIN f ON f.sid = b.sid AND b.d >= f.d", "panel fundamentals")
def d29(spark, sf):
    from tidemark.operators.joins import asof_backward

    # a session back, as long as the security was there: the row before belongs to the same span if it is the session before
    w = Window.partitionBy("sid").orderBy("idx")
    b = views.panel(spark, sf).select("sid", "d", F.when(F.lag("idx").over(w) == C("idx") - 1, F.lag("close").over(w)).alias("lagged"))
    f = views.fundamentals(spark, sf).groupBy("sid", C("available_date").alias("d")).agg(F.max("n").alias("n"))
    return asof_backward(b, f, ["sid"], "d", ["n"]).select("sid", "d", "lagged", "n")


@query("d31_membership_intervals", """, r AS (SELECT b.sid, c.d, c.idx - row_number() OVER (PARTITION BY sid ORDER BY c.idx) AS run FROM bars b JOIN calendar c USING (d)) SELECT sid, min(d) AS "from", max(d) AS "to" FROM r GROUP BY sid, run""", "calendar")
def d31(spark, sf):
    b = views.bars(spark, sf)
    return warehouse.membership_intervals(b, views.calendar(b), ["sid"], "d")


@query("d32_ticker_spans", "SELECT sid, min(d) AS first, max(d) AS last FROM (SELECT sid, d FROM bars UNION ALL SELECT sid, d FROM long_bars) GROUP BY sid", "bars long_bars")
def d32(spark, sf):
    return warehouse.ticker_spans(views.bars(spark, sf), views.long_bars(spark, sf))


@query("d33_export_tables", "SELECT sid AS code, d AS date, round(amount / 1000, 6) AS amount_thousand FROM bars WHERE d > (SELECT max(d) FROM bars) - 10", "bars")
def d33(spark, sf):
    from tidemark.functions.clean import to_unit

    b = views.bars(spark, sf)
    newest = b.agg(F.date_sub(F.max("d"), 10).alias("cut"))
    return b.join(F.broadcast(newest), C("d") > C("cut")).select(C("sid").alias("code"), C("d").alias("date"), F.round(to_unit(C("amount"), "won", "thousand"), 6).alias("amount_thousand"))


# ---- models


@query("m01_price_indicators", ", r AS (SELECT sid, d, close, row_number() OVER w AS i, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lag(close, 21) OVER w AS l21, lag(close, 63) OVER w AS l63 FROM long_bars WINDOW w AS (PARTITION BY sid ORDER BY d)) SELECT sid, d, CASE WHEN count(ret) OVER b >= 45 THEN round(stddev_samp(ret) OVER b * sqrt(252), 5) END AS vol, round(close / nullif(l21, 0) - 1, 6) AS r1m, round(close / nullif(l63, 0) - 1, 6) AS r3m FROM r WINDOW b AS (PARTITION BY sid ORDER BY d ROWS 59 PRECEDING)", "long_bars")
def m01(spark, sf):
    m = models.price_indicators(views.long_bars(spark, sf), ["sid"], "d", "close", F.lit(True))
    return m.select("sid", "d", F.round("vol", 5).alias("vol"), F.round("r1m", 6).alias("r1m"), F.round("r3m", 6).alias("r3m"))


@query("m02_pullback", "SELECT sid, d, round((percent_rank() OVER (PARTITION BY d ORDER BY amount) + percent_rank() OVER (PARTITION BY d ORDER BY -close)) / 2, 6) AS score FROM panel", "panel")
def m02(spark, sf):
    p = views.panel(spark, sf)
    return p.select("sid", "d", F.round(models.pullback(p, ["d"], "amount", "close"), 6).alias("score"))


@query("m03_fin_indicators", ", k AS (SELECT *, lag(revenue, 4) OVER w AS y, year(q) * 4 + quarter(q) - lag(year(q) * 4 + quarter(q), 4) OVER w AS gap FROM fundamentals WINDOW w AS (PARTITION BY sid ORDER BY q)) SELECT sid, q, CASE WHEN gap = 4 THEN round(revenue / nullif(y, 0) - 1, 6) END AS growth, round(revenue / n, 4) AS margin FROM k", "fundamentals")
def m03(spark, sf):
    w = Window.partitionBy("sid").orderBy("q")
    qi = F.year("q") * 4 + F.quarter("q")
    f = views.fundamentals(spark, sf).withColumn("gap", qi - F.lag(qi, 4).over(w)).withColumn("y", F.lag("revenue", 4).over(w))
    return f.select("sid", "q", F.when(C("gap") == 4, F.round(F.try_divide("revenue", "y") - 1, 6)).alias("growth"), F.round(C("revenue") / C("n"), 4).alias("margin"))


@query("m04_flow_indicators", "SELECT sid, d, CASE WHEN count(amount) OVER w = 10 THEN round(sum(amount) OVER w / nullif(close * volume, 0), 6) END AS flow, volume - lag(volume, 5) OVER (PARTITION BY sid ORDER BY idx) AS change FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx ROWS 9 PRECEDING)", "panel")
def m04(spark, sf):
    w = Window.partitionBy("sid").orderBy("idx")
    b = w.rowsBetween(-9, 0)
    flow = F.when(F.count("amount").over(b) == 10, F.round(F.try_divide(F.sum("amount").over(b), C("close") * C("volume")), 6))
    return views.panel(spark, sf).select("sid", "d", flow.alias("flow"), (C("volume") - F.lag("volume", 5).over(w)).alias("change"))


@query("m05_revisions", ", e AS (SELECT sid, q, revenue - 150000 AS now, lag(revenue - 150000) OVER (PARTITION BY sid ORDER BY q) AS before, n FROM fundamentals) SELECT sid, q, round(CASE WHEN n >= 2 AND before <> 0 THEN (now - before) / abs(before) END, 6) AS revision, CASE WHEN n >= 2 AND before <> 0 THEN CAST(sign(now) <> sign(before) AS INT) END AS flipped FROM e", "fundamentals")
def m05(spark, sf):
    f = views.fundamentals(spark, sf).withColumn("now", C("revenue") - 150000)
    f = f.withColumn("before", F.lag("now").over(Window.partitionBy("sid").orderBy("q")))
    r, flip = models.revisions(f, "now", "before", "n", 2)
    return f.select("sid", "q", F.round(r, 6).alias("revision"), flip.cast("int").alias("flipped"))


def _pct(x, part="d"):
    return f"CASE WHEN count(*) OVER (PARTITION BY {part}) = 1 THEN 50 ELSE (rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0 - 1) * 100 / (count(*) OVER (PARTITION BY {part}) - 1) END"


@query("m06_score_rank_model", f", p AS (SELECT sid, d, ({_pct('amount')} + {_pct('volume')}) / 2 AS a, {_pct('-close')} AS b FROM panel) SELECT sid, d, round(0.6 * a + 0.4 * b, 5) AS score FROM p", "panel")
def m06(spark, sf):
    spec = {"flow": {"weight": 0.6, "items": {"amount": 1, "volume": 1}}, "value": {"weight": 0.4, "items": {"close": -1}}}
    return rnd(models.score_rank_model(views.panel(spark, sf), ["d"], spec).select("sid", "d", "score"), "score", places=5)


@query("m07_apply_gates", f", p AS (SELECT sid, d, {_pct('amount')} AS a, {_pct('close')} AS c FROM panel) SELECT sid, d, CASE WHEN a < 20 THEN 'amount_bottom' WHEN c > 90 THEN 'close_top' END AS gate FROM p", "panel")
def m07(spark, sf):
    p = views.panel(spark, sf)
    return p.select("sid", "d", models.apply_gates(p, ["d"], [("amount", "bottom", 20.0), ("close", "top", 10.0)]).alias("gate"))


_Z = "CASE WHEN count({0}) OVER (PARTITION BY d) < 2 OR stddev_samp({0}) OVER (PARTITION BY d) = 0 THEN 0 ELSE greatest(-3, least(3, ({0} - avg({0}) OVER (PARTITION BY d)) / stddev_samp({0}) OVER (PARTITION BY d))) END"


@query("m08_score_z_model", f"SELECT sid, d, round(0.5 * {_Z.format('close')} + 0.5 * -({_Z.format('amount')}), 5) AS score FROM panel", "panel")
def m08(spark, sf):
    return rnd(models.score_z_model(views.panel(spark, sf), ["d"], {"close": (0.5, 1), "amount": (0.5, -1)}).select("sid", "d", "score"), "score", places=5)


@query("m09_score_percentrank_model", "SELECT sid, d, round(0.7 * coalesce((rank() OVER (PARTITION BY d ORDER BY close) - 1) / nullif(count(*) OVER (PARTITION BY d) - 1, 0), 0) + 0.3 * coalesce(1 - (rank() OVER (PARTITION BY d ORDER BY amount) - 1) / nullif(count(*) OVER (PARTITION BY d) - 1, 0), 0), 6) AS score FROM panel", "panel")
def m09(spark, sf):
    return rnd(models.score_percentrank_model(views.panel(spark, sf), ["d"], {"close": (0.7, False), "amount": (0.3, True)}).select("sid", "d", "score"), "score")


@query("m10_compare_scores", ", r AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY close) + (count(*) OVER (PARTITION BY d, close) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY d ORDER BY amount) + (count(*) OVER (PARTITION BY d, amount) - 1) / 2.0 AS rb, row_number() OVER (PARTITION BY d ORDER BY close DESC, sid) AS ta, row_number() OVER (PARTITION BY d ORDER BY amount DESC, sid) AS tb FROM panel) SELECT d, count(*) AS common, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS spearman, count(*) FILTER (ta <= 5 AND tb <= 5) AS overlap FROM r GROUP BY d", "panel")
def m10(spark, sf):
    p = views.panel(spark, sf)
    c = models.compare_scores(p.select("d", "sid", C("close").alias("score")), p.select("d", "sid", C("amount").alias("score")), ["d"], "sid", 5)
    return rnd(c, "spearman")


@query("m11_model_checks", "SELECT d, count(*) AS n, round(min(close), 4) AS lo, round(max(close), 4) AS hi, count(*) >= 5 AS enough FROM panel GROUP BY d", "panel")
def m11(spark, sf):
    return views.panel(spark, sf).groupBy("d").agg(F.count("*").alias("n"), F.round(F.min("close"), 4).alias("lo"), F.round(F.max("close"), 4).alias("hi"), (F.count("*") >= 5).alias("enough"))


_RK = ", k AS (SELECT sid, idx, row_number() OVER (PARTITION BY idx ORDER BY close DESC, sid) AS rank FROM panel)"


def ranked(spark, sf):
    return views.panel(spark, sf).select("sid", "idx", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("close"), "sid")).alias("rank"))


@query("m12_rank_trend", _RK + " SELECT a.sid, a.idx, a.rank, b.rank - a.rank AS w1 FROM k a LEFT JOIN k b ON b.sid = a.sid AND b.idx = a.idx - 5", "panel")
def m12(spark, sf):
    return models.rank_trend(ranked(spark, sf), "sid", "idx", "rank", {"w1": 5})


@query("m12_list_moves", _RK + ", t AS (SELECT sid, idx FROM k WHERE rank <= 3) SELECT coalesce(a.sid, b.sid) AS sid, coalesce(a.idx, b.idx + 1) AS idx, CASE WHEN b.sid IS NULL THEN 'in' ELSE 'out' END AS move FROM t a FULL JOIN t b ON a.sid = b.sid AND a.idx = b.idx + 1 WHERE (a.sid IS NULL OR b.sid IS NULL) AND coalesce(a.idx, b.idx + 1) <= (SELECT max(idx) FROM k) AND coalesce(a.idx, b.idx + 1) > (SELECT min(idx) FROM k)", "panel")
def m12b(spark, sf):
    return models.list_moves(ranked(spark, sf), "sid", "idx", "rank", 3)


@query("m13_pick_scorecard", _RK + " SELECT k.idx, count(*) AS picks, round(avg(y.close / nullif(x.close, 0) - 1), 5) AS ret FROM k JOIN panel x USING (sid, idx) JOIN panel y ON y.sid = k.sid AND y.idx = k.idx + 5 WHERE k.rank > 3 AND k.rank <= 6 GROUP BY k.idx", "panel")
def m13(spark, sf):
    p = views.panel(spark, sf).select("sid", "idx", "close")
    later = p.select("sid", (C("idx") - 5).alias("idx"), C("close").alias("later"))
    j = ranked(spark, sf).where("rank > 3 AND rank <= 6").join(p, ["sid", "idx"]).join(later, ["sid", "idx"])
    return j.groupBy("idx").agg(F.count("*").alias("picks"), F.round(F.avg(F.try_divide("later", "close") - 1), 5).alias("ret"))


@query("m17_excess_z", _RET + ", x AS (SELECT sid, idx, ret - iret AS x FROM r) SELECT sid, idx, round(CASE WHEN count(x) OVER w >= 5 THEN x / nullif(stddev_samp(x) OVER w, 0) END, 5) AS z FROM x WINDOW w AS (PARTITION BY sid ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", "panel")
def m17(spark, sf):
    return rnd(models.excess_z(returns(spark, sf), ["sid"], "idx", "ret", "iret", 10).select("sid", "idx", "z"), "z", places=5)


# ---- data quality


@query("q03_cast_loss", "SELECT count(*) AS n, round(avg(CASE WHEN l_orderkey % 7 IN (1, 2, 3) THEN 1.0 ELSE 0.0 END), 6) AS lost FROM lineitem WHERE l_orderkey % 7 <> 5")
def q03(spark, sf):
    from tidemark.functions.clean import NumberRule, cast_numeric

    r = raw(spark, sf).where("s IS NOT NULL").withColumn("v", cast_numeric(C("s"), NumberRule(sign="strip")))
    return r.agg(F.count("*").alias("n"), F.round(F.avg(C("v").isNull().cast("int")), 6).alias("lost"))


@query("q04_invariants", "SELECT 'discount' AS rule, count(*) FILTER (NOT l_discount <= 0.08) AS violations FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (NOT l_quantity > 0) FROM lineitem")
def q04(spark, sf):
    return quality.check_invariants(views.read(spark, sf, "lineitem"), {"discount": "l_discount <= 0.08", "quantity": "l_quantity > 0"})


@query("q04_key_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q04b(spark, sf):
    return quality.duplicate_keys(views.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q05_golden", "SELECT n_nationkey, n_name, n_regionkey < 3 AS ok FROM nation")
def q05(spark, sf):
    n = views.read(spark, sf, "nation")
    return quality.check_golden(n.where("n_regionkey < 3"), n.select("n_nationkey", "n_name"), ["n_nationkey"], "n_name")


@query("q06_versions", "SELECT sid, d, count(*) AS n FROM versions GROUP BY ALL HAVING count(*) > 1", "versions")
def q06(spark, sf):
    return quality.duplicate_keys(views.versions(spark, sf), ["sid", "d"])


@query("q07_ranges", "SELECT count(*) AS n, count(*) FILTER (o_orderdate < DATE '1995-06-01' OR o_orderdate > DATE '2001-01-01') AS out FROM orders")
def q07(spark, sf):
    d = C("o_orderdate").cast("date")
    return views.read(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_if((d < F.lit(datetime.date(1995, 6, 1))) | (C("o_orderdate") > F.lit("2001-01-01").cast("timestamp_ntz"))).alias("out"))


@query("q09_cross_match", """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN price * 2 WHEN l_orderkey % 97 = 1 AND l_linenumber = 1 THEN NULL ELSE price END AS price FROM b WHERE NOT (l_orderkey % 97 = 2 AND l_linenumber = 2))
    SELECT 'price' AS "column", count(*) FILTER (a.price IS NOT NULL AND b.price IS NOT NULL) AS "both", count(*) FILTER (b.price IS NOT NULL AND a.price IS NULL) AS left_only, count(*) FILTER (a.price IS NOT NULL AND b.price IS NULL) AS right_only, count(*) FILTER (a.price = b.price) AS equal FROM b FULL JOIN a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def q09(spark, sf):
    return quality.cross_survey(*two_builds(spark, sf), ["l_orderkey", "l_linenumber"], ["price"])


@query("q10_pit", "SELECT count(*) FILTER (available_date IS NULL) AS no_date, count(*) FILTER (available_date < q + 100) AS before_content, count(*) FILTER (available_date > DATE '2000-01-01') AS after_snapshot FROM fundamentals", "fundamentals")
def q10(spark, sf):
    return quality.check_pit(views.fundamentals(spark, sf).withColumn("c", F.date_add("q", 100)), "c", "available_date", datetime.date(2000, 1, 1))


@query("q11_recent_grid", ", n AS (SELECT d, count(*) AS rows, row_number() OVER (ORDER BY d DESC) AS r FROM bars GROUP BY d) SELECT d, rows, round((SELECT avg(rows) FROM n WHERE r > 5), 6) AS usual, rows >= 0.9 * (SELECT avg(rows) FROM n WHERE r > 5) AS ok FROM n WHERE r <= 5", "bars")
def q11(spark, sf):
    return rnd(quality.recent_completeness(views.bars(spark, sf), "d", 5, 0.9), "usual")


@query("q12_reproducible", None)
def q12(spark, sf):
    b = views.bars(spark, sf).select("sid", "d", "open", "high", "low", "close", "volume")
    one, two = quality.content_hash(b), quality.content_hash(b.repartition(7, "d"))
    return one.join(F.broadcast(two.select(C("hash").alias("again"))), C("hash") == C("again")).select("rows", "hash")


@query("q14_ledger_health", "SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) >= 10 AND count(DISTINCT event_type) >= 4 AS ok FROM events GROUP BY 1")
def q14(spark, sf):
    g = views.read(spark, sf, "events").groupBy(C("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))
    return g.withColumn("ok", (C("n") >= 10) & (C("kinds") >= 4))


@query("q15_window_verdict", ", x AS (SELECT d, count(*) % 5 <> 0 AS ok FROM bars GROUP BY d), g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY d) AS g FROM x), r AS (SELECT d, CASE WHEN ok THEN row_number() OVER (PARTITION BY g ORDER BY d) - CASE WHEN g = 0 THEN 0 ELSE 1 END ELSE 0 END AS run FROM g) SELECT d, run, run >= 3 AS passed FROM r", "bars")
def q15(spark, sf):
    days = views.bars(spark, sf).groupBy("d").agg((F.count("*") % 5 != 0).alias("ok"))
    return quality.window_verdict(days, "d", "ok", 3)


@query("q16_freshness", ", a AS (SELECT sid, idx, idx - max(CASE WHEN volume >= 3 THEN idx END) OVER (PARTITION BY sid ORDER BY idx) AS age FROM panel) SELECT sid, idx, CASE WHEN age IS NULL THEN 'none' WHEN age <= 2 THEN 'fresh' WHEN age <= 5 THEN 'grace' ELSE 'lapsed' END AS state FROM a", "panel")
def q16(spark, sf):
    p = views.panel(spark, sf).withColumn("seen", C("volume") >= 3)
    return quality.freshness(p, ["sid"], "idx", "seen", 2, 5).select("sid", "idx", "state")


@query("s06_union_sources", "SELECT src, count(*) AS n, count(value) AS with_value, count(payload) AS with_payload FROM (SELECT 'a' AS src, value, NULL AS payload FROM versions UNION ALL SELECT 'b', NULL, payload FROM versions) GROUP BY src", "versions")
def s06(spark, sf):
    from tidemark.sources.tables import union_sources

    v = views.versions(spark, sf)
    u = union_sources({"a": v.select("sid", "value"), "b": v.select("sid", "payload")})
    return u.groupBy(C("_src").alias("src")).agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count("payload").alias("with_payload"))


@query("s19_profile_table", "SELECT 'o_orderpriority' AS \"column\", count(*) AS rows, count(*) FILTER (o_orderpriority IS NULL) AS nulls, count(*) FILTER (trim(o_orderpriority) = '') AS blanks, max(length(o_orderpriority)) AS longest FROM orders")
def s19(spark, sf):
    return quality.profile_table(views.read(spark, sf, "orders"), ["o_orderpriority"]).select("column", "rows", "nulls", "blanks", "longest")
