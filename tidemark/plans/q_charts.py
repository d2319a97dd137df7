"""Technical indicators and chart analysis, parsing of pages, content hashes."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import quality, technical
from tidemark.sources import text

from . import views
from .registry import query

C = F.col
BY = ["sid"]
W = "WINDOW w AS (PARTITION BY sid ORDER BY idx)"


def rnd(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else C(c) for c in df.columns])


@query("t01_bollinger", "SELECT sid, idx, CASE WHEN count(close) OVER b = 5 THEN round(avg(close) OVER b, 6) END AS mid, CASE WHEN count(close) OVER b = 5 THEN round(avg(close) OVER b + 2 * stddev_pop(close) OVER b, 6) END AS up FROM panel WINDOW b AS (PARTITION BY sid ORDER BY idx ROWS 4 PRECEDING)", "panel")
def t01(spark, sf):
    m, u, _ = technical.bollinger(BY, "idx", C("close"), 5, 2.0)
    return rnd(views.panel(spark, sf).select("sid", "idx", m.alias("mid"), u.alias("up")), "mid", "up")


@query("t02_recursive_indicators", None)
def t02(spark, sf):
    return technical.recursive_indicators(views.panel(spark, sf), "sid", "idx", 5, 4, 8, 3)


@query("t03_true_range", f"SELECT sid, idx, round(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), 6) AS tr FROM panel {W}", "panel")
def t03(spark, sf):
    return views.panel(spark, sf).select("sid", "idx", F.round(technical.true_range(BY, "idx"), 6).alias("tr"))


@query("t05_ichimoku", "SELECT sid, idx, CASE WHEN count(high) OVER b = 4 THEN round((max(high) OVER b + min(low) OVER b) / 2, 6) END AS tenkan, CASE WHEN count(high) OVER c = 8 THEN round((max(high) OVER c + min(low) OVER c) / 2, 6) END AS span_b FROM panel WINDOW b AS (PARTITION BY sid ORDER BY idx ROWS 3 PRECEDING), c AS (PARTITION BY sid ORDER BY idx ROWS BETWEEN 13 PRECEDING AND 6 PRECEDING)", "panel")
def t05(spark, sf):
    i = technical.ichimoku(BY, "idx", 4, 6, 8)
    return rnd(views.panel(spark, sf).select("sid", "idx", i["tenkan"].alias("tenkan"), i["span_b"].alias("span_b")), "tenkan", "span_b")


@query("t06_obv", f", v AS (SELECT sid, idx, coalesce(sign(close - lag(close) OVER w), 0) * volume AS v FROM panel {W}) SELECT sid, idx, CAST(sum(v) OVER (PARTITION BY sid ORDER BY idx) AS DOUBLE) AS obv FROM v", "panel")
def t06(spark, sf):
    return technical.obv(views.panel(spark, sf), BY, "idx").select("sid", "idx", "obv")


@query("t07_stochastic", ", k AS (SELECT sid, idx, CASE WHEN count(*) OVER b = 5 THEN (close - min(low) OVER b) / nullif(max(high) OVER b - min(low) OVER b, 0) * 100 END AS k FROM panel WINDOW b AS (PARTITION BY sid ORDER BY idx ROWS 4 PRECEDING)) SELECT sid, idx, CASE WHEN count(k) OVER b = 3 THEN round(avg(k) OVER b, 5) END AS slow_k FROM k WINDOW b AS (PARTITION BY sid ORDER BY idx ROWS 2 PRECEDING)", "panel")
def t07(spark, sf):
    return rnd(technical.stochastic(views.panel(spark, sf), BY, "idx", 5, 3).select("sid", "idx", "slow_k"), "slow_k", places=5)


@query("t08_pivot_points", ", p AS (SELECT sid, date_trunc('week', d) AS p, max(high) AS h, min(low) AS l, arg_max(close, d) AS c FROM panel GROUP BY ALL), q AS (SELECT sid, p, (lag(h) OVER w + lag(l) OVER w + lag(c) OVER w) / 3 AS pp, lag(l) OVER w AS pl FROM p WINDOW w AS (PARTITION BY sid ORDER BY p)) SELECT b.sid, b.d, round(pp, 6) AS pivot_, round(2 * pp - pl, 6) AS r1 FROM panel b JOIN q ON q.sid = b.sid AND q.p = date_trunc('week', b.d)", "panel")
def t08(spark, sf):
    return rnd(technical.pivot_points(views.panel(spark, sf), "sid", "d", "week").select("sid", "d", C("pivot").alias("pivot_"), "r1"), "pivot_", "r1")


@query("t09_volume_profile", """, e AS (SELECT sid, min(low) AS lo, max(high) AS hi FROM panel GROUP BY sid), x AS (SELECT p.*, e.lo, (e.hi - e.lo) / 6 AS w FROM panel p JOIN e USING (sid) WHERE e.hi > e.lo), y AS (SELECT *, unnest(range(CAST(least(5, floor((low - lo) / w)) AS BIGINT), CAST(least(5, floor((high - lo) / w)) AS BIGINT) + 1)) AS bin FROM x)
    SELECT sid, CAST(bin AS INT) AS bin, round(sum(volume * CASE WHEN high > low THEN greatest(0, least(high, lo + (bin + 1) * w) - greatest(low, lo + bin * w)) / (high - low) ELSE 1 END), 6) AS volume FROM y GROUP BY sid, bin""", "panel")
def t09(spark, sf):
    return rnd(technical.volume_profile(views.panel(spark, sf), "sid", 6).select("sid", "bin", "volume"), "volume")


def _pivots(spark, sf):
    return technical.zigzag(views.panel(spark, sf), "sid", "idx", 3, 0.3)


@query("t10_zigzag", None)
def t10(spark, sf):
    return _pivots(spark, sf)


@query("t11_signal_events", ", m AS (SELECT sid, idx, close, CASE WHEN count(close) OVER b = 5 THEN avg(close) OVER b END AS m, CASE WHEN count(high) OVER c = 10 THEN max(high) OVER c END AS hi FROM panel WINDOW b AS (PARTITION BY sid ORDER BY idx ROWS 4 PRECEDING), c AS (PARTITION BY sid ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT sid, idx, coalesce(close > m AND lag(close < m) OVER w, false) AS cross_up, coalesce(close > hi, false) AS breakout FROM m WINDOW w AS (PARTITION BY sid ORDER BY idx)", "panel")
def t11(spark, sf):
    return technical.signal_events(views.panel(spark, sf), "sid", "idx").select("sid", "idx", "cross_up", "breakout")


@query("t12_candle_patterns", f"SELECT sid, idx, coalesce(lag(close) OVER w < lag(open) OVER w AND close > open AND close >= lag(open) OVER w AND open <= lag(close) OVER w, false) AS engulfing, coalesce(low > lag(high) OVER w, false) AS gap_up FROM panel {W}", "panel")
def t12(spark, sf):
    return technical.candle_patterns(views.panel(spark, sf), "sid", "idx").select("sid", "idx", "engulfing", "gap_up")


@query("t13_candles", "SELECT sid, CAST(date_trunc('week', d) AS DATE) AS start, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, CAST(sum(volume) AS BIGINT) AS volume, date_trunc('week', d) = DATE '2024-01-15' AS in_progress FROM panel WHERE d <= DATE '2024-01-17' GROUP BY sid, date_trunc('week', d)", "panel")
def t13(spark, sf):
    return technical.candles(views.panel(spark, sf), "sid", "d", "week", datetime.date(2024, 1, 17)).drop("last")


@query("t14_zones", None)
def t14(spark, sf):
    return technical.zones(_pivots(spark, sf).where("price > 0"), "sid", "price", 0.05)


@query("t15_channels", None)
def t15(spark, sf):
    lows = _pivots(spark, sf).where("kind = 'low'").select("sid", "idx", "price")
    return technical.channels(lows, views.panel(spark, sf), "sid", "idx", 6, 3)


@query("t16_regime", f", r AS (SELECT sid, idx, ln(close / nullif(lag(close) OVER w, 0)) AS r FROM (SELECT * FROM panel WHERE close > 0) {W}), s AS (SELECT sid, idx, CASE WHEN count(r) OVER b = 6 THEN sum(r) OVER b / nullif(stddev_samp(r) OVER b * sqrt(6), 0) END AS s FROM r WINDOW b AS (PARTITION BY sid ORDER BY idx ROWS 5 PRECEDING)) SELECT sid, idx, round(s, 5) AS strength, CASE WHEN s IS NULL THEN 'none' WHEN s > 1 THEN 'up' WHEN s < -1 THEN 'down' ELSE 'box' END AS regime FROM s", "panel")
def t16(spark, sf):
    return rnd(technical.regime(views.panel(spark, sf).where("close > 0"), "sid", "idx", 6), "strength", places=5)


@query("t17_retracement", ", e AS (SELECT sid, min(low) AS lo, max(high) AS hi FROM panel GROUP BY sid), s AS (SELECT unnest([0.236, 0.382, 0.5, 0.618, 0.786]) AS share) SELECT sid, CAST(share AS DOUBLE) AS share, round(hi - (hi - lo) * share, 6) AS level FROM e, s", "panel")
def t17(spark, sf):
    e = views.panel(spark, sf).groupBy("sid").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    return rnd(technical.retracement(e, "sid", "lo", "hi"), "level")


@query("t17_confluence", ", b AS MATERIALIZED (SELECT sid, floor(low) AS lo, floor(high) + 1 AS hi, volume % 4 AS kind FROM panel), e AS (SELECT sid, lo FROM b UNION SELECT sid, hi FROM b), n AS MATERIALIZED (SELECT sid, lo, lead(lo) OVER (PARTITION BY sid ORDER BY lo) AS hi FROM e) SELECT n.sid, n.lo, n.hi, count(DISTINCT kind) AS kinds FROM n JOIN b ON b.sid = n.sid WHERE n.hi IS NOT NULL AND b.lo - n.lo <= 0 AND b.hi - n.hi >= 0 GROUP BY ALL HAVING count(DISTINCT kind) >= 2", "panel")
def t17b(spark, sf):
    b = views.panel(spark, sf).select("sid", F.floor("low").cast("double").alias("lo"), (F.floor("high") + 1).cast("double").alias("hi"), (C("volume") % 4).alias("kind"))
    return technical.confluence(b, "sid")


@query("t19_reactions", ", l AS (SELECT sid, median(close) AS level FROM panel GROUP BY sid), f AS (SELECT *, lead(close, 2) OVER (PARTITION BY sid ORDER BY idx) AS f FROM panel) SELECT f.sid, idx, round(level, 6) AS level, CAST(abs(f - level) > abs(close - level) AS INT) AS bounced FROM f JOIN l USING (sid) WHERE low <= level * 1.02 AND high >= level * 0.98", "panel")
def t19(spark, sf):
    p = views.panel(spark, sf)
    lv = p.groupBy("sid").agg(F.median("close").alias("level"))
    return rnd(technical.reactions(p, lv, "sid", "idx", 0.02, 2).withColumn("bounced", C("bounced").cast("int")), "level")


@query("t20_avoid_flags", ", h AS (SELECT sid, idx, close, volume, CASE WHEN count(*) OVER b = 6 THEN max(high) OVER b END AS hi FROM panel WINDOW b AS (PARTITION BY sid ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) SELECT sid, idx, concat_ws(',', CASE WHEN close > hi THEN 'breakout' END, CASE WHEN volume < 2 THEN 'thin' END) AS flags FROM h", "panel")
def t20(spark, sf):
    from tidemark.functions.series import ts_max

    hi = ts_max(BY, "idx", C("high"), 6, 1)
    p = views.panel(spark, sf).withColumn("hi", hi)
    return p.select("sid", "idx", F.concat_ws(",", F.when(C("close") > C("hi"), "breakout"), F.when(C("volume") < 2, "thin")).alias("flags"))


@query("t21_rescale", ", r AS (SELECT sid, arg_max(close, idx) / nullif(arg_max(close * 2 + 1, idx), 0) AS r FROM panel GROUP BY sid) SELECT sid, idx, round((close * 2 + 1) * r, 6) AS shown FROM panel JOIN r USING (sid)", "panel")
def t21(spark, sf):
    p = views.panel(spark, sf).withColumn("adj", C("close") * 2 + 1)
    return rnd(technical.rescale(p, "sid", "idx", "adj", "close").select("sid", "idx", "shown"), "shown")


@query("t22_nearest_levels", """, l AS (SELECT sid, close AS level, 40.0 AS price FROM panel WHERE close > 0), n AS (SELECT *, CASE WHEN ln(level) - ln(lag(level) OVER (PARTITION BY sid ORDER BY level)) <= 0.03 THEN 0 ELSE 1 END AS n, row_number() OVER (PARTITION BY sid ORDER BY level) AS i FROM l), g AS (SELECT *, sum(n) OVER (PARTITION BY sid ORDER BY i) AS g FROM n), a AS (SELECT sid, g, avg(level) AS level FROM g GROUP BY sid, g),
    s AS (SELECT sid, level, CASE WHEN level >= 40 THEN 'above' ELSE 'below' END AS side FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY sid, side ORDER BY abs(level - 40), level) AS place FROM s) SELECT sid, side, place, round(level, 6) AS level FROM k WHERE place <= 2""", "panel")
def t22(spark, sf):
    lv = views.panel(spark, sf).where("close > 0").select("sid", C("close").alias("level"), F.lit(40.0).alias("price"))
    return rnd(technical.nearest_levels(lv, "sid", "level", "price", 0.03, 2), "level")


@query("t23_observe_rows", ", s AS (SELECT d, sid, 'active' AS signal FROM panel WHERE volume >= 5 UNION ALL SELECT d, sid, 'dear' FROM panel WHERE close > 60), g AS (SELECT d, signal FROM calendar, (SELECT unnest(['active', 'dear']) AS signal)) SELECT g.d, g.signal, coalesce(array_to_string(list(s.sid ORDER BY s.sid) FILTER (s.sid IS NOT NULL), ','), '') AS ids FROM g LEFT JOIN s USING (d, signal) GROUP BY ALL", "panel")
def t23(spark, sf):
    p = views.panel(spark, sf).select("d", "sid", (C("volume") >= 5).alias("active"), (C("close") > 60).alias("dear"))
    return technical.observe_rows(p, views.calendar(views.bars(spark, sf)), "d", "sid", ["active", "dear"])


# ---- pages and tables


def _html(spark, sf):
    o = views.read(spark, sf, "orders")
    row = F.concat(F.lit("<tr><td>"), C("o_orderkey").cast("string"), F.lit("</td><td> "), C("o_orderstatus"), F.lit(" </td></tr>"))
    return o.groupBy(C("o_custkey").alias("id")).agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))


@query("s13_html_tables", "WITH r AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY '<tr><td>' || o_orderkey || '</td><td>') - 1 AS row_no, o_orderkey || '|' || o_orderstatus AS cells FROM orders) SELECT id, 0 AS table_no, CAST(row_no AS INT) AS row_no, cells FROM r")
def s13(spark, sf):
    return text.html_tables(_html(spark, sf), "id", "html").withColumn("cells", F.array_join("cells", "|"))


@query("s14_parse_prelim", "SELECT o_custkey AS id, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS final, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'no_result' END AS failure FROM orders GROUP BY 1")
def s14(spark, sf):
    t = text.html_tables(_html(spark, sf), "id", "html")
    g = t.groupBy("id").agg(F.count("*").alias("rows"), F.count_if(F.get("cells", F.lit(1)) == "F").alias("final"))
    return g.withColumn("failure", F.when(C("final") == 0, "no_result"))


@query("s15_doc_text", None)
def s15(spark, sf):
    p = views.read(spark, sf, "pages").select("page_id", C("html").cast("binary").alias("content"))
    return text.doc_text(p, "content").select("page_id", "text")


@query("s16_doc_sections", None)
def s16(spark, sf):
    return text.doc_sections(views.read(spark, sf, "pages"), "page_id", "html")


@query("s18_content_hash", None)
def s18(spark, sf):
    return quality.content_hash(views.read(spark, sf, "orders"))


@query("s07_decode_props", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def s07(spark, sf):
    e = views.read(spark, sf, "events")
    return e.select(F.from_json("props", "k int").alias("j")).groupBy(C("j.k").alias("k")).agg(F.count("*").alias("n"))


@query("s09_decode_matrix", "SELECT id, CAST(i AS INT) AS lookback, v FROM (SELECT o_orderkey AS id, unnest(range(1, 4)) AS i, unnest([o_totalprice, o_totalprice * 2, o_totalprice * 3]) AS v FROM orders)")
def s09(spark, sf):
    o = views.read(spark, sf, "orders").select(C("o_orderkey").alias("id"), *[(C("o_totalprice") * i).alias(f"VAL{i}") for i in (1, 2, 3)])
    return o.unpivot("id", ["VAL1", "VAL2", "VAL3"], "slot", "v").select("id", F.substring("slot", 4, 1).cast("int").alias("lookback"), "v")


@query("w24_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) WHERE new = 1 GROUP BY user_id")
def w24(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = views.read(spark, sf, "events").withColumn("new", F.when(C("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    return e.where("new = 1").groupBy("user_id").agg(F.count("*").alias("sessions"))
