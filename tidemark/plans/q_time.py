"""Joins in time, versions, publication cuts and cleaning."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import joins, universe, versions

from . import views
from .registry import query

C = F.col
BY = ["sid"]


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("j01_join_grid", ", g AS (SELECT s.sid, c.d, c.idx FROM (SELECT DISTINCT sid FROM bars) s CROSS JOIN calendar c) SELECT g.sid, g.d, g.idx, b.close FROM g LEFT JOIN bars b USING (sid, d)", "calendar")
def j01(spark, sf):
    b = views.bars(spark, sf)
    grid = b.select("sid").distinct().withColumn("k", F.lit(1)).join(F.broadcast(views.calendar(b).select("d", "idx").withColumn("k", F.lit(1))), "k").drop("k")
    return grid.join(b.select("sid", "d", "close"), ["sid", "d"], "left").select("sid", "d", "idx", "close")


_PUB = "SELECT sid, available_date AS d, max(revenue) AS revenue FROM fundamentals GROUP BY ALL"
_ORD = "SELECT DISTINCT sid, d FROM versions"


def _pub(spark, sf):
    return views.fundamentals(spark, sf).groupBy("sid", C("available_date").alias("d")).agg(F.max("revenue").alias("revenue"))


@query("j02_asof_backward", f", p AS ({_PUB}), o AS ({_ORD}) SELECT o.sid, o.d, p.d AS d_matched, round(p.revenue, 6) AS revenue FROM o ASOF LEFT JOIN p ON o.sid = p.sid AND o.d >= p.d", "fundamentals versions")
def j02(spark, sf):
    o = views.versions(spark, sf).select("sid", "d").distinct()
    return joins.asof_backward(o, _pub(spark, sf), BY, "d", ["revenue"]).select("sid", "d", "d_matched", r6(C("revenue"), "revenue"))


@query("j03_asof_strict", f", p AS ({_PUB}), o AS ({_ORD}) SELECT o.sid, o.d, p.d AS d_matched, round(p.revenue, 6) AS revenue FROM o ASOF LEFT JOIN p ON o.sid = p.sid AND o.d > p.d", "fundamentals versions")
def j03(spark, sf):
    o = views.versions(spark, sf).select("sid", "d").distinct()
    return joins.asof_backward(o, _pub(spark, sf), BY, "d", ["revenue"], strict=True).select("sid", "d", "d_matched", r6(C("revenue"), "revenue"))


@query("j04_asof_forward", f", p AS ({_PUB}), o AS ({_ORD}) SELECT o.sid, o.d, p.d AS d_matched, round(p.revenue, 6) AS revenue FROM o ASOF LEFT JOIN p ON o.sid = p.sid AND o.d <= p.d", "fundamentals versions")
def j04(spark, sf):
    o = views.versions(spark, sf).select("sid", "d").distinct()
    return joins.asof_forward(o, _pub(spark, sf), BY, "d", ["revenue"]).select("sid", "d", "d_matched", r6(C("revenue"), "revenue"))


@query("j05_range_join", ", r AS (SELECT sid, idx AS lo, idx + volume % 4 AS hi FROM panel WHERE idx % 5 = 0) SELECT p.sid, p.idx, r.lo, r.hi, p.close FROM panel p JOIN r ON p.sid = r.sid AND p.idx BETWEEN r.lo AND r.hi", "panel")
def j05(spark, sf):
    p = views.panel(spark, sf)
    r = p.where("idx % 5 = 0").select("sid", C("idx").cast("long").alias("lo"), (C("idx") + C("volume") % 4).cast("long").alias("hi"))
    return joins.range_join(p.select("sid", C("idx").cast("long").alias("idx"), "close"), r, BY, "idx", "lo", "hi").select("sid", "idx", "lo", "hi", "close")


@query("j06_event_window", ", e AS (SELECT DISTINCT sid, idx FROM panel WHERE volume >= 4) SELECT DISTINCT p.sid, p.idx, p.close FROM panel p JOIN e ON p.sid = e.sid AND p.idx BETWEEN e.idx - 2 AND e.idx + 3", "panel")
def j06(spark, sf):
    p = views.panel(spark, sf)
    w = joins.expand_event_window(p.where("volume >= 4").select("sid", "idx"), BY, "idx", 2, 3)
    return p.join(w, ["sid", "idx"]).select("sid", "idx", "close")


@query("j07_match_best", """, u AS (SELECT sid, idx AS u_at, close AS u_value FROM panel WHERE idx % 2 = 0 AND close > 0), s AS (SELECT sid, idx AS s_at, close AS s_value FROM panel WHERE idx % 2 = 1),
    j AS (SELECT u.sid, u_at, s_at, u_value, s_value, abs(s_value / u_value - 1) AS gap FROM u JOIN s ON u.sid = s.sid AND abs(u_at - s_at) <= 5 WHERE abs(s_value / u_value - 1) <= 0.3),
    r AS (SELECT *, row_number() OVER (PARTITION BY sid, u_at ORDER BY gap, abs(u_at - s_at), s_at) AS ru, row_number() OVER (PARTITION BY sid, s_at ORDER BY gap, abs(u_at - s_at), u_at) AS rs FROM j)
    SELECT sid, u_at, s_at, u_value, s_value FROM r WHERE ru = 1 AND rs = 1""", "panel")
def j07(spark, sf):
    p = views.panel(spark, sf).select("sid", "idx", "close")
    return joins.match_best(p.where("idx % 2 = 0 AND close > 0"), p.where("idx % 2 = 1"), BY, "idx", "close", 5, 0.3)


@query("j08_suppress_near_dups", """SELECT a.sid, a.d, a.payload, a.seq FROM versions a WHERE NOT EXISTS (SELECT 1 FROM versions b WHERE b.sid = a.sid AND b.payload = a.payload AND abs(date_diff('day', a.d, b.d)) <= 30 AND b.seq < a.seq)""", "versions")
def j08(spark, sf):
    v = views.versions(spark, sf).select("sid", "d", "payload", "seq")
    return joins.suppress_near_dups(v, ["sid", "payload"], "d", "seq", 30)


@query("j09_semi_anti", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def j09(spark, sf):
    c, o = views.read(spark, sf, "customer"), views.read(spark, sf, "orders")
    kept = c.join(o.where("o_totalprice > 400000").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    has = o.where("o_orderstatus = 'F'").select(C("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return kept.join(has, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_f"))


_AFTER = """a AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k, CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN l_extendedprice * 2 WHEN l_orderkey % 97 = 1 AND l_linenumber = 1 THEN NULL ELSE l_extendedprice END AS price FROM lineitem WHERE NOT (l_orderkey % 97 = 2 AND l_linenumber = 2))"""


def two_builds(spark, sf):
    x = views.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C("l_extendedprice").alias("price"))
    one = x.groupBy("l_orderkey", "l_linenumber").agg(F.max("price").alias("price"))
    m, first = C("l_orderkey") % 97, C("l_linenumber") == 1
    after = one.where(~((m == 2) & (C("l_linenumber") == 2))).withColumn("price", F.when((m == 0) & first, C("price") * 2).when(~((m == 1) & first), C("price")))
    return one, after


@query("j10_diff_builds", """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
    a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN price * 2 WHEN l_orderkey % 97 = 1 AND l_linenumber = 1 THEN NULL ELSE price END AS price FROM b WHERE NOT (l_orderkey % 97 = 2 AND l_linenumber = 2))
    SELECT count(*) FILTER (b.l_orderkey IS NULL) AS added, count(*) FILTER (a.l_orderkey IS NULL) AS removed, count(*) FILTER (a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL) AS common,
    count(*) FILTER (a.price <> b.price) AS price_changed, count(*) FILTER (a.l_orderkey IS NOT NULL AND b.price IS NOT NULL AND a.price IS NULL) AS price_lost, count(*) FILTER (b.l_orderkey IS NOT NULL AND b.price IS NULL AND a.price IS NOT NULL) AS price_gained
    FROM b FULL JOIN a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def j10(spark, sf):
    return joins.diff_builds(*two_builds(spark, sf), ["l_orderkey", "l_linenumber"], ["price"])


@query("j11_prev_opinion", """, o AS (SELECT sid, q, available_date AS known, n FROM fundamentals) SELECT a.sid, a.q, a.known, a.n, p.n AS prev_value, p.known AS prev_known FROM o a LEFT JOIN LATERAL (
    SELECT b.n, b.known FROM o b WHERE b.sid = a.sid AND b.q < a.q AND b.known <= a.q ORDER BY b.q DESC, b.known DESC LIMIT 1) p ON true""", "fundamentals")
def j11(spark, sf):
    o = views.fundamentals(spark, sf).select("sid", "q", C("available_date").alias("known"), "n")
    return joins.previous_opinion(o, BY, "q", "known", "n")


@query("j12_link_corrections", """, v AS (SELECT *, payload = 'P' AS corr FROM versions), w AS (SELECT sid, d, seq, corr, last(CASE WHEN NOT corr THEN seq END IGNORE NULLS) OVER x AS original, count(CASE WHEN NOT corr THEN seq END) OVER x AS candidates FROM v WINDOW x AS (PARTITION BY sid ORDER BY d, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT sid, d, seq, original, candidates FROM w WHERE corr""", "versions")
def j12(spark, sf):
    v = views.versions(spark, sf).select("sid", "d", "seq", "payload")
    return joins.link_corrections(v, BY, "d", "seq", C("payload") == "P").select("sid", "d", "seq", "original", "candidates")


@query("j13_event_components", """, e AS (SELECT DISTINCT sid, idx FROM panel WHERE volume >= 3), n AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY sid ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS new FROM e),
    c AS (SELECT sid, idx, CAST(sum(new) OVER (PARTITION BY sid ORDER BY idx) AS BIGINT) AS component FROM n) SELECT *, count(*) OVER (PARTITION BY sid, component) AS size FROM c""", "panel")
def j13(spark, sf):
    e = views.panel(spark, sf).where("volume >= 3").select("sid", "idx").distinct()
    return joins.event_components(e, BY, "idx", 2)


@query("j14_corp_bridge", """WITH l AS (SELECT l_partkey % 50 AS corp, l_partkey AS ticker, max(l_shipdate) AS d, min(CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS common FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY d DESC, ticker) AS i FROM l) SELECT r.corp, r.ticker, r.common, p.p_brand AS brand FROM r LEFT JOIN part p ON p.p_partkey = r.ticker WHERE i = 1""")
def j14(spark, sf):
    x = views.read(spark, sf, "lineitem")
    legs = x.groupBy((C("l_partkey") % 50).alias("corp"), C("l_partkey").alias("ticker")).agg(F.max("l_shipdate").alias("d"), F.min(F.when(C("l_returnflag") == "A", C("l_suppkey"))).alias("common"))
    one = versions.first_version(legs, ["corp"], [F.desc("d"), "ticker"])
    part = views.read(spark, sf, "part").select(C("p_partkey").alias("ticker"), C("p_brand").alias("brand"))
    return one.join(part, "ticker", "left").select("corp", "ticker", "common", "brand")


@query("j15_with_consts", "SELECT sid, d, round(close * 1.5 + 2, 6) AS x FROM panel", "panel")
def j15(spark, sf):
    scale, shift = 1.5, 2
    return views.panel(spark, sf).select("sid", "d", r6(C("close") * scale + shift, "x"))


# ---- versions

_V = "SELECT sid, d, seq, payload, value"


@query("v01_first_version", ", r AS (SELECT *, row_number() OVER (PARTITION BY sid, payload ORDER BY d, seq) AS i, count(*) OVER (PARTITION BY sid, payload) AS n_src_rows FROM versions) SELECT sid, payload, d, seq, n_src_rows FROM r WHERE i = 1", "versions")
def v01(spark, sf):
    return versions.first_version(views.versions(spark, sf), ["sid", "payload"], ["d", "seq"]).select("sid", "payload", "d", "seq", "n_src_rows")


@query("v02_latest_per_key", ", r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d DESC, seq DESC) AS i FROM versions) SELECT sid, d, seq FROM r WHERE i = 1", "versions")
def v02(spark, sf):
    return versions.latest_per_key(views.versions(spark, sf), BY, ["d", "seq"]).select("sid", "d", "seq")


@query("v03_dedupe_payload", "SELECT sid, payload, min(seq) AS seq, count(*) AS n_observed FROM versions GROUP BY ALL", "versions")
def v03(spark, sf):
    return versions.dedupe_payload(views.versions(spark, sf), BY, ["payload"], ["seq"]).select("sid", "payload", "seq", "n_observed")


@query("v04_fold_same_day", "SELECT sid, d, max(seq) AS seq FROM versions GROUP BY ALL", "versions")
def v04(spark, sf):
    return versions.fold_same_day(views.versions(spark, sf), BY, "d", ["seq"]).select("sid", "d", "seq")


@query("v05_fold_consecutive", ", l AS (SELECT *, lag(payload) OVER (PARTITION BY sid ORDER BY d, seq) AS p FROM versions) SELECT sid, d, seq, payload FROM l WHERE payload IS DISTINCT FROM p", "versions")
def v05(spark, sf):
    return versions.fold_consecutive(views.versions(spark, sf), BY, ["d", "seq"], "payload").select("sid", "d", "seq", "payload")


@query("v06_stale_keys", ", l AS (SELECT payload, sid, max(d) AS last FROM versions GROUP BY ALL), n AS (SELECT *, max(last) OVER (PARTITION BY payload) AS newest FROM l) SELECT * FROM n WHERE last < newest", "versions")
def v06(spark, sf):
    return versions.stale_keys(views.versions(spark, sf), "payload", "sid", "d")


@query("v07_fold_with_rejects", "SELECT sid, d, seq, CASE WHEN row_number() OVER (PARTITION BY sid, payload ORDER BY d, seq) > 1 THEN 'version_folded' END AS reject_reason FROM versions", "versions")
def v07(spark, sf):
    return versions.fold_with_rejects(views.versions(spark, sf), ["sid", "payload"], ["d", "seq"]).select("sid", "d", "seq", "reject_reason")


_TWO = """, s AS (SELECT sid, CAST(date_trunc('month', d) AS DATE) AS m, d + CAST(sid % 9 AS INTEGER) AS available, 'a' AS src, value FROM versions WHERE payload = 'F' UNION ALL
    SELECT sid, CAST(date_trunc('month', d) AS DATE), d + 4, 'b', value FROM versions WHERE payload <> 'F')"""


def _two_sources(spark, sf):
    v = views.versions(spark, sf)
    m = F.date_trunc("month", "d").cast("date").alias("m")
    a = v.where("payload = 'F'").select("sid", m, F.date_add("d", (C("sid") % 9).cast("int")).alias("available"), F.lit("a").alias("src"), "value")
    return a.unionByName(v.where("payload <> 'F'").select("sid", m, F.date_add("d", 4).alias("available"), F.lit("b").alias("src"), "value"))


@query("v08_first_known", _TWO + ", r AS (SELECT *, row_number() OVER (PARTITION BY sid, m ORDER BY available, src, value) AS i FROM s) SELECT sid, m, available, src, value FROM r WHERE i = 1", "versions")
def v08(spark, sf):
    return versions.first_version(_two_sources(spark, sf), ["sid", "m"], ["available", "src", "value"]).select("sid", "m", "available", "src", "value")


@query("v09_pick_source", _TWO + ", r AS (SELECT *, row_number() OVER (PARTITION BY sid, m ORDER BY CASE src WHEN 'b' THEN 1 ELSE 2 END) AS i FROM (SELECT sid, m, src, max(value) AS value FROM s GROUP BY ALL)) SELECT sid, m, src, value FROM r WHERE i = 1", "versions")
def v09(spark, sf):
    s = _two_sources(spark, sf).groupBy("sid", "m", "src").agg(F.max("value").alias("value"))
    return versions.pick_source(s, ["sid", "m"], "src", ["b", "a"])


@query("v10_union_all", _TWO + " SELECT src, count(*) AS n FROM s GROUP BY src", "versions")
def v10(spark, sf):
    return _two_sources(spark, sf).groupBy("src").agg(F.count("*").alias("n"))


@query("v11_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def v11(spark, sf):
    o = views.read(spark, sf, "orders").select(C("o_custkey").alias("k"))
    return o.union(views.read(spark, sf, "customer").where("c_acctbal > 0").select(C("c_custkey").alias("k"))).distinct()


@query("v12_set_compare", """WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN r ON l.k = r.k""")
def v12(spark, sf):
    o = views.read(spark, sf, "orders").select(C("o_custkey").alias("k"), "o_orderstatus")
    return versions.set_compare(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["k"])


@query("v13_jaccard_mean", """, x AS (SELECT d, list(DISTINCT sid) AS x FROM panel WHERE volume >= 2 GROUP BY d), y AS (SELECT d, list(DISTINCT sid) AS y FROM panel WHERE close > 8 GROUP BY d)
    SELECT round(avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS jaccard, count(*) AS periods FROM x JOIN y USING (d)""", "panel")
def v13(spark, sf):
    p = views.panel(spark, sf)
    return versions.jaccard_mean(p.where("volume >= 2"), p.where("close > 8"), "d", "sid").select(r6(C("jaccard"), "jaccard"), "periods")


# ---- what may be used when


@query("f01_pit_cut", """, cut AS (SELECT d FROM calendar WHERE idx = (SELECT max(idx) FROM calendar WHERE d <= DATE '2024-01-20') - 2) SELECT sid, d FROM bars WHERE d + 1 <= (SELECT d FROM cut)""", "calendar")
def f01(spark, sf):
    b = views.bars(spark, sf)
    known = b.select("sid", "d", F.date_add("d", 1).alias("available_date"))
    return universe.pit_cut(known, views.calendar(b), datetime.date(2024, 1, 20), 2).select("sid", "d")


@query("f02_policy", "SELECT sid, d, volume >= 2 AS investable, volume >= 2 AND amount > 30 AND sector <> 3 AS liquid FROM panel", "panel")
def f02(spark, sf):
    rows = {"investable": ["volume >= 2"], "liquid": ["volume >= 2", "amount > 30", "sector <> 3"]}
    return views.panel(spark, sf).select("sid", "d", *[universe.policy(p).alias(n) for n, p in rows.items()])


@query("f03_eligibility_absolute", "SELECT sid, d, concat_ws(',', CASE WHEN x IS NULL THEN 'x_missing' WHEN NOT x > 5 THEN 'x_gt' END, CASE WHEN NOT volume >= 2 THEN 'volume_gte' END) AS reasons FROM (SELECT *, CASE WHEN sid % 7 <> 0 THEN close END AS x FROM panel)", "panel")
def f03(spark, sf):
    p = views.panel(spark, sf).withColumn("x", F.when(C("sid") % 7 != 0, C("close")))
    return p.select("sid", "d", F.array_join(universe.eligibility_absolute([("x", "gt", 5.0), ("volume", "gte", 2.0)]), ",").alias("reasons"))


@query("f04_eligibility_top", "SELECT sid, d, row_number() OVER (PARTITION BY d ORDER BY close DESC, sid) <= floor(count(*) OVER (PARTITION BY d) * 0.3 + 1e-9) AS top FROM panel", "panel")
def f04(spark, sf):
    return universe.eligibility_top(views.panel(spark, sf), ["d"], "close", "sid", percent=0.3, name="top").select("sid", "d", "top")


@query("f05_guard_future", "SELECT sid, q, CASE WHEN available_date <= DATE '1998-01-31' THEN n END AS n FROM fundamentals", "fundamentals")
def f05(spark, sf):
    return views.fundamentals(spark, sf).select("sid", "q", universe.guard_future(C("n"), C("available_date"), F.lit("1998-01-31").cast("date")).alias("n"))


@query("f06_grid_reject", """, c AS (SELECT d FROM calendar WHERE idx >= 5 AND idx % 7 <> 0), g AS (SELECT DISTINCT sid, d FROM bars WHERE volume >= 2) SELECT b.sid, b.d, CASE WHEN b.d < (SELECT min(d) FROM c) THEN 'pre_calendar' WHEN c.d IS NULL THEN 'off_calendar' WHEN g.d IS NULL THEN 'off_grid' END AS reject_reason
    FROM bars b LEFT JOIN c ON c.d = b.d LEFT JOIN g ON g.sid = b.sid AND g.d = b.d""", "calendar")
def f06(spark, sf):
    b = views.bars(spark, sf).select("sid", "d", "volume")
    return universe.grid_reject(b.select("sid", "d"), b.where("volume >= 2"), ["sid", "d"], views.calendar(b).where("idx >= 5 AND idx % 7 <> 0"), "d")


@query("f07_compare", "SELECT sid, d, close > open AS gt, close <= low AS lte, volume = 2 AS eq FROM panel", "panel")
def f07(spark, sf):
    k = universe.COMPARE
    return views.panel(spark, sf).select("sid", "d", k["gt"](C("close"), C("open")).alias("gt"), k["lte"](C("close"), C("low")).alias("lte"), k["eq"](C("volume"), 2).alias("eq"))


@query("f08_model_universe", "SELECT sid, d, CASE WHEN NOT volume >= 2 THEN 'illiquid' WHEN NOT sector IN (0, 1, 2) THEN 'market' WHEN NOT amount >= 20 THEN 'small' END AS exclude_reason FROM panel", "panel")
def f08(spark, sf):
    rules = [("illiquid", C("volume") >= 2), ("market", C("sector").isin(0, 1, 2)), ("small", C("amount") >= 20)]
    return views.panel(spark, sf).select("sid", "d", universe.first_failing(rules).alias("exclude_reason"))


@query("f09_signal_filters", "SELECT sid, d, CASE WHEN NOT close >= 5 THEN 'score' WHEN NOT amount >= 15 THEN 'liquidity' END AS reason FROM panel", "panel")
def f09(spark, sf):
    return views.panel(spark, sf).select("sid", "d", universe.first_failing([("score", C("close") >= 5), ("liquidity", C("amount") >= 15)]).alias("reason"))


@query("f10_selection_funnel", "SELECT reason, count(*) AS count FROM (SELECT unnest(CASE WHEN close > 5 AND volume >= 2 THEN ['eligible'] ELSE list_filter([CASE WHEN NOT close > 5 THEN 'close_gt' END, CASE WHEN NOT volume >= 2 THEN 'volume_gte' END], lambda x: x IS NOT NULL) END) AS reason FROM panel) GROUP BY reason", "panel")
def f10(spark, sf):
    p = views.panel(spark, sf).select(universe.eligibility_absolute([("close", "gt", 5.0), ("volume", "gte", 2.0)]).alias("reasons"))
    return universe.selection_funnel(p, "reasons")


# ---- cleaning

_RAW = """WITH raw AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_orderkey % 7 WHEN 0 THEN '+' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) WHEN 1 THEN '-' WHEN 2 THEN '' WHEN 3 THEN 'x1' WHEN 4 THEN '0' WHEN 5 THEN NULL ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS s FROM lineitem)"""


def raw(spark, sf):
    x = views.read(spark, sf, "lineitem")
    whole = F.floor("l_extendedprice")
    m = C("l_orderkey") % 7
    s = F.when(m == 0, F.concat(F.lit("+"), F.format_number(whole, 0))).when(m == 1, "-").when(m == 2, "").when(m == 3, "x1").when(m == 4, "0").when(m != 5, whole.cast("string"))
    return x.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), s.alias("s"))


@query("p01_cast_numeric", _RAW + " SELECT k, n, CAST(nullif(try_cast(ltrim(replace(s, ',', ''), '+') AS DOUBLE), 0) AS DOUBLE) * 1000 AS v FROM raw")
def p01(spark, sf):
    rule = clean.NumberRule(sign="strip", scale="1000", zero_missing=True)
    return raw(spark, sf).select("k", "n", clean.cast_numeric(C("s"), rule).cast("double").alias("v"))


@query("p02_cast_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR year(o_orderdate) > 1997 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def p02(spark, sf):
    o = views.read(spark, sf, "orders")
    s = F.when(C("o_orderkey") % 3 == 0, "19999999").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", clean.cast_date(s, "compact", 1950, 1997).alias("d"))


@query("p03_miss_kind", _RAW + " SELECT coalesce(CASE k % 7 WHEN 1 THEN 'dash' WHEN 2 THEN 'blank' WHEN 3 THEN 'cast_failed' WHEN 4 THEN 'zero' WHEN 5 THEN 'ledger_null' END, CASE WHEN try_cast(ltrim(replace(s, ',', ''), '+') AS DOUBLE) > 90000 THEN 'out_of_range' END, 'value') AS kind, count(*) AS n FROM raw GROUP BY 1")
def p03(spark, sf):
    rule = clean.NumberRule(sign="strip", zero_missing=True, hi=90000)
    return raw(spark, sf).groupBy(F.coalesce(clean.miss_kind(C("s"), rule), F.lit("value")).alias("kind")).agg(F.count("*").alias("n"))


@query("p05_split_rejects", _RAW + ", c AS (SELECT k, n, s, try_cast(ltrim(replace(s, ',', ''), '+') AS DOUBLE) AS v FROM raw) SELECT CASE WHEN s IS NULL THEN 'required_null' WHEN v IS NULL THEN 'cast_failed' WHEN v > 90000 THEN 'out_of_range' END AS reject_reason, count(*) AS n FROM c GROUP BY 1")
def p05(spark, sf):
    v = clean.cast_numeric(C("s"), clean.NumberRule(sign="strip"))
    reason = universe.first_failing([("required_null", C("s").isNotNull()), ("cast_failed", C("v").isNotNull()), ("out_of_range", C("v") <= 90000)])
    return raw(spark, sf).withColumn("v", v).groupBy(reason.alias("reject_reason")).agg(F.count("*").alias("n"))


@query("p06_clean_bars", """, x AS (SELECT sid, d, open, close, CASE WHEN sid % 3 = 0 THEN low ELSE high END AS high, low, volume FROM bars) SELECT sid, d, greatest(high, low, open, close) AS high, least(high, low, open, close) AS low, greatest(high, low, open, close) <> high OR least(high, low, open, close) <> low AS repaired
    FROM x WHERE volume > 1 AND least(high, low, open, close) > 0""", "bars")
def p06(spark, sf):
    b = views.bars(spark, sf).withColumn("high", F.when(C("sid") % 3 == 0, C("low")).otherwise(C("high")))
    from tidemark.operators.warehouse import clean_bars

    return clean_bars(b, "clamp", True, min_volume=2).select("sid", "d", "high", "low", "repaired")


@query("p07_price_kind", "SELECT sid, d, CASE WHEN volume > 1 THEN 'trade' ELSE 'reference' END AS kind, round(close - (close - open), 6) AS base FROM bars", "bars")
def p07(spark, sf):
    kind = F.when(C("volume") > 1, "trade").otherwise("reference")
    return views.bars(spark, sf).select("sid", "d", kind.alias("kind"), r6(C("close") - (C("close") - C("open")), "base"))


@query("p08_observed_date", "SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS d FROM events")
def p08(spark, sf):
    return views.read(spark, sf, "events").select("event_id", clean.observed_date(C("ts").cast("string")).alias("d"))


@query("p09_assign_available", "SELECT o_orderkey, greatest(CAST(o_orderdate AS DATE) + 1, CAST(coalesce(n.r, DATE '1990-01-01') AS DATE)) AS available_date FROM orders o LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS r FROM lineitem GROUP BY 1) n ON n.l_orderkey = o.o_orderkey")
def p09(spark, sf):
    look = views.read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.max(C("l_shipdate").cast("date")).alias("r"))
    o = views.read(spark, sf, "orders").join(look, "o_orderkey", "left")
    return o.select("o_orderkey", F.greatest(F.date_add(C("o_orderdate").cast("date"), 1), F.coalesce("r", F.lit("1990-01-01").cast("date"))).alias("available_date"))


@query("p10_classify", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_size > 30 THEN 'large' WHEN regexp_matches(p_type, '^(ECON|PROMO)') THEN 'cheap' ELSE 'other' END AS class FROM part")
def p10(spark, sf):
    rules = [("ring", C("p_name").contains("ring")), ("large", C("p_size") > 30), ("cheap", C("p_type").rlike("^(ECON|PROMO)"))]
    return views.read(spark, sf, "part").select("p_partkey", clean.classify(rules, "other").alias("class"))


@query("p11_disclosure_flags", r"""SELECT source, lang, bool_or(regexp_matches(t, '(?i)licen[sc]e')) AS licence, bool_or(regexp_matches(t, '^[A-ZÉÈÀÖÜÄ ]{12,}')) AS shout FROM (SELECT source, lang, regexp_replace(text, '^\[[^\]]*\]', '') AS t FROM documents) GROUP BY ALL""")
def p11(spark, sf):
    d = views.read(spark, sf, "documents").withColumn("t", F.regexp_replace("text", r"^\[[^\]]*\]", ""))
    return d.groupBy("source", "lang").agg(F.bool_or(C("t").rlike("(?i)licen[sc]e")).alias("licence"), F.bool_or(C("t").rlike("^[A-ZÉÈÀÖÜÄ ]{12,}")).alias("shout"))


@query("p12_to_unit", "SELECT o_orderkey, round(o_totalprice / 1000, 6) AS thousand FROM orders")
def p12(spark, sf):
    return views.read(spark, sf, "orders").select("o_orderkey", r6(clean.to_unit(C("o_totalprice"), "won", "thousand"), "thousand"))


@query("p14_yoy", """, x AS (SELECT sid, q, revenue - 100000 AS v, lag(revenue - 100000) OVER (PARTITION BY sid ORDER BY q) AS p FROM fundamentals) SELECT sid, q, round(CASE WHEN p > 0 THEN v / p - 1 END, 6) AS growth,
    CASE WHEN p < 0 AND v >= 0 THEN 'to_profit' WHEN p >= 0 AND v < 0 THEN 'to_loss' WHEN p < 0 AND v < 0 THEN 'still_loss' END AS word FROM x""", "fundamentals")
def p14(spark, sf):
    f = views.fundamentals(spark, sf).withColumn("v", C("revenue") - 100000)
    f = f.withColumn("p", F.lag("v").over(Window.partitionBy("sid").orderBy("q")))
    g, w = clean.yoy(C("v"), C("p"))
    return f.select("sid", "q", r6(g, "growth"), w.alias("word"))


@query("p15_map_accounts", """WITH r AS (SELECT o_custkey AS sid, o_orderpriority AS concept, count(DISTINCT o_orderstatus) AS k, min(o_orderstatus) AS v FROM orders GROUP BY ALL)
    SELECT sid, max(CASE WHEN concept = '1-URGENT' THEN CASE WHEN k > 1 THEN 'ambiguous' ELSE v END END) AS urgent, max(CASE WHEN concept = '5-LOW' THEN CASE WHEN k > 1 THEN 'ambiguous' ELSE v END END) AS low FROM r GROUP BY sid""")
def p15(spark, sf):
    from tidemark.operators.warehouse import map_accounts

    facts = views.read(spark, sf, "orders").select(C("o_custkey").alias("sid"), C("o_orderpriority").alias("concept"), C("o_orderstatus").alias("amount"))
    rules = {"urgent": ["1-URGENT"], "low": ["5-LOW"]}
    return map_accounts(facts, ["sid"], "concept", "amount", rules)


@query("p16_revenue_fallback", """SELECT o_custkey AS sid, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN 'direct' WHEN count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('2-HIGH', '5-LOW')) = 2 THEN 'summed' END AS basis,
    round(CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') WHEN count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('2-HIGH', '5-LOW')) = 2 THEN sum(o_totalprice) FILTER (o_orderpriority IN ('2-HIGH', '5-LOW')) END, 4) AS revenue FROM orders GROUP BY 1""")
def p16(spark, sf):
    from tidemark.operators.warehouse import revenue_fallback

    f = views.read(spark, sf, "orders").select(C("o_custkey").alias("sid"), C("o_orderpriority").alias("concept"), C("o_totalprice").alias("amount"))
    return revenue_fallback(f, ["sid"], "concept", "amount", "1-URGENT", ["2-HIGH", "5-LOW"]).select("sid", "basis", F.round("revenue", 4).alias("revenue"))


@query("p17_fin_anomalies", "SELECT l_orderkey, l_linenumber, l_extendedprice, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice - o_totalprice > 0")
def p17(spark, sf):
    x, o = views.read(spark, sf, "lineitem"), views.read(spark, sf, "orders")
    j = x.join(o, x.l_orderkey == o.o_orderkey)
    return j.where(C("l_extendedprice") - C("o_totalprice") > 0).select("l_orderkey", "l_linenumber", "l_extendedprice", "o_totalprice")


@query("p18_unpivot_slots", "SELECT o_orderkey AS k, s.i AS slot, s.i * o_totalprice AS v FROM orders, (SELECT unnest([0, 1, 2]) AS i) s")
def p18(spark, sf):
    o = views.read(spark, sf, "orders")
    slots = F.array(*[F.struct((C("o_totalprice") * i).alias("v")) for i in range(3)])
    return o.select(C("o_orderkey").alias("k"), F.posexplode(slots).alias("slot", "s")).select("k", "slot", "s.v")


@query("p19_metrics_long", "SELECT sid, d, metric, value FROM (UNPIVOT (SELECT sid, d, CASE WHEN sid % 3 <> 0 THEN open END AS open, close FROM bars) ON open, close INTO NAME metric VALUE value)".replace("FROM bars", "FROM (" + views.SQL["bars"] + ")"))
def p19(spark, sf):
    b = views.bars(spark, sf).select("sid", "d", F.when(C("sid") % 3 != 0, C("open")).alias("open"), "close")
    return b.unpivot(["sid", "d"], ["open", "close"], "metric", "value").where("value IS NOT NULL")


@query("p20_pivot_preference", """WITH x AS (SELECT o_custkey AS sid, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS b, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS c FROM orders GROUP BY 1)
    SELECT sid, coalesce(a, b, c) AS amount, CASE WHEN a IS NOT NULL THEN 'F' WHEN b IS NOT NULL THEN 'O' WHEN c IS NOT NULL THEN 'P' END AS basis FROM x""")
def p20(spark, sf):
    from tidemark.operators.warehouse import pivot_preferred

    return pivot_preferred(views.read(spark, sf, "orders").withColumnRenamed("o_custkey", "sid"), ["sid"], "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("p04_normalize_text", "SELECT p_partkey, trim(regexp_replace(upper(p_name || '  ' || p_brand), '\\s+', ' ', 'g')) AS name FROM part")
def p04(spark, sf):
    from tidemark.sources.text import normalize_text

    p = views.read(spark, sf, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit("\t \n"), F.upper("p_brand")).alias("name"))
    return normalize_text(p, ["name"])
