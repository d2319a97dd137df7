"""Signal evaluation, performance and experiment statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins, measures, stats

from . import views
from .registry import query

C = F.col
ACC = ["account"]


def rnd(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else C(c) for c in df.columns])


_LAB = """, h AS (SELECT sid, idx, close AS entry, unnest([1, 5]) AS horizon FROM panel), l AS (SELECT h.sid, h.idx, h.horizon, CASE WHEN h.idx + horizon > (SELECT max(idx) FROM calendar) THEN 'not_matured' WHEN h.idx + horizon > max(h.idx) OVER (PARTITION BY h.sid) THEN 'listing_ended' WHEN x.close IS NULL THEN 'gap' WHEN entry = 0 THEN 'missing_entry' ELSE 'ok' END AS status, x.close / nullif(entry, 0) - 1 AS r
    FROM h LEFT JOIN panel x ON x.sid = h.sid AND x.idx = h.idx + h.horizon), labels_ AS (SELECT sid, idx, horizon, CASE WHEN status = 'ok' THEN r END AS label, status FROM l)"""


def labels(spark, sf, keep=None):
    return stats.forward_labels(views.panel(spark, sf), ["sid"], "idx", "close", None, [1, 5], keep)


@query("e01_forward_labels", _LAB + " SELECT sid, idx, horizon, round(label, 6) AS label, status FROM labels_", "panel")
def e01(spark, sf):
    return rnd(labels(spark, sf), "label")


@query("e02_rank_ic", _LAB + """, r AS (SELECT l.idx, horizon, rank() OVER (a ORDER BY p.volume) + (count(*) OVER (PARTITION BY l.idx, horizon, p.volume) - 1) / 2.0 AS x, rank() OVER (a ORDER BY label) + (count(*) OVER (PARTITION BY l.idx, horizon, label) - 1) / 2.0 AS y FROM labels_ l JOIN panel p USING (sid, idx) WHERE label IS NOT NULL WINDOW a AS (PARTITION BY l.idx, horizon))
    SELECT idx, horizon, count(*) AS n, CASE WHEN count(*) < 4 THEN 'too_few' WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 'constant' ELSE 'ok' END AS status, round(CASE WHEN count(*) >= 4 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS ic FROM r GROUP BY idx, horizon""", "panel")
def e02(spark, sf):
    return rnd(stats.rank_ic(labels(spark, sf, ["volume"]), ["idx", "horizon"], "volume", "label", 4), "ic")


@query("e03_ic_exclusions", _LAB + " SELECT horizon, status, count(*) AS n FROM labels_ GROUP BY ALL", "panel")
def e03(spark, sf):
    return labels(spark, sf).groupBy("horizon", "status").agg(F.count("*").alias("n"))


@query("e04_factor_returns", """, x AS (SELECT idx, sid, amount AS cap, close / amount AS v, open / nullif(close, 0) - 1 AS r FROM panel), y AS (SELECT * FROM x WHERE r IS NOT NULL), z AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY idx ORDER BY cap, sid) <= floor(count(*) OVER (PARTITION BY idx) / 2) THEN 'S' ELSE 'B' END AS s, row_number() OVER (PARTITION BY idx ORDER BY v, sid) AS k, count(*) OVER (PARTITION BY idx) AS n FROM y),
    t AS (SELECT *, CASE WHEN k <= floor(n * 0.3) THEN 'L' WHEN k > n - floor(n * 0.3) THEN 'H' ELSE 'M' END AS g FROM z),
    c AS (SELECT idx, sum(r * cap) / sum(cap) AS mkt, """ + ", ".join(f"sum(r * cap) FILTER (s = '{s}' AND g = '{g}') / nullif(sum(cap) FILTER (s = '{s}' AND g = '{g}'), 0) AS {s}{g}" for s in "SB" for g in "LMH") + """ FROM t GROUP BY idx)
    SELECT idx, round(mkt, 6) AS mkt, round((SL + SM + SH - BL - BM - BH) / 3, 6) AS smb, round((SH + BH - SL - BL) / 2, 6) AS hml FROM c""", "panel")
def e04(spark, sf):
    p = views.panel(spark, sf).select("idx", "sid", C("amount").alias("cap"), (C("close") / C("amount")).alias("v"), (F.try_divide(C("open"), C("close")) - 1).alias("r"))
    return rnd(stats.factor_returns(p, ["idx"], "sid", "cap", "v", "r"), "mkt", "smb", "hml")


_NW = """, s AS (SELECT {key}, {order} AS t, {y} AS y, {x} AS x FROM {source}), m AS (SELECT *, avg(x) OVER p AS mx, avg(y) OVER p AS my, count(*) OVER p AS n, row_number() OVER (PARTITION BY {key} ORDER BY t) AS i FROM s WHERE y IS NOT NULL WINDOW p AS (PARTITION BY {key})),
    c AS (SELECT *, x - mx AS u, least(24, CAST(floor(4 * pow(n / 100.0, 2 / 9.0)) AS INT)) AS lag FROM m), bb AS (SELECT {key}, sum(u * y) / nullif(sum(u * u), 0) AS beta, sum(u * u) AS sxx FROM c GROUP BY {key}), e AS (SELECT c.*, beta, sxx, y - my - coalesce(beta * u, 0) AS e FROM c JOIN bb USING ({key})),
    w AS (SELECT a.{key}, sum(CASE WHEN a.i = b.i THEN 1.0 ELSE 1 - abs(a.i - b.i) / (a.lag + 1.0) END * a.e * b.e) AS s00, sum(CASE WHEN a.i = b.i THEN 1.0 ELSE 1 - abs(a.i - b.i) / (a.lag + 1.0) END * a.e * b.u * b.e) AS s01, sum(CASE WHEN a.i = b.i THEN 1.0 ELSE 1 - abs(a.i - b.i) / (a.lag + 1.0) END * a.u * a.e * b.u * b.e) AS s11 FROM e a JOIN e b ON a.{key} = b.{key} AND abs(a.i - b.i) <= a.lag GROUP BY 1),
    g AS (SELECT {key}, any_value(n) AS n, any_value(lag) AS lag, any_value(beta) AS beta, any_value(my) AS my, any_value(mx) AS mx, any_value(sxx) AS sxx FROM e GROUP BY {key})"""


@query("e05_newey_west", ", r AS (SELECT account, d, equity / lag(equity) OVER (PARTITION BY account ORDER BY d) - 1 AS ret FROM curve)" + _NW.format(key="account", order="d", y="ret", x="day(d)", source="r") + " SELECT account, n, lag, round(my - beta * mx, 8) AS alpha, round(beta, 9) AS beta, round(sqrt(s00 / (n * n) - 2 * mx * s01 / (n * sxx) + mx * mx * s11 / (sxx * sxx)), 8) AS se_alpha, round(sqrt(s11) / sxx, 9) AS se_beta FROM g JOIN w USING (account)", "curve")
def e05(spark, sf):
    c = stats.with_returns(views.curve(spark, sf), ACC, "d", "equity").withColumn("t", F.dayofmonth("d").cast("double"))
    r = measures.newey_west_by(c, ACC, "d", "ret", "t")
    return rnd(rnd(r, "alpha", "se_alpha", places=8), "beta", "se_beta", places=9)


_SUP = "li AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"


@query("e06_mean_difference", "WITH " + _SUP + ", r AS (SELECT sid, d, close / lag(close) OVER (PARTITION BY sid ORDER BY d) - 1 - (close - 900) / 1000 AS x FROM li)" + _NW.format(key="sid", order="d", y="x", x="0.0", source="r") + " SELECT sid, n, lag, round(my, 8) AS difference, round(my / nullif(sqrt(s00) / n, 0), 6) AS t FROM g JOIN w USING (sid)")
def e06b(spark, sf):
    b = views.long_bars(spark, sf)
    r = stats.with_returns(b, ["sid"], "d", "close").withColumn("other", (C("close") - 900) / 1000)
    return rnd(rnd(measures.mean_difference(r, ["sid"], "d", "ret", "other").drop("p"), "t"), "difference", places=8)


@query("e06_holm", """WITH p AS (SELECT event_type AS name, (count(*) % 97) / 970.0 AS p FROM events GROUP BY 1), s AS (SELECT name, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS s FROM p)
    SELECT name, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM s""")
def e06(spark, sf):
    p = views.read(spark, sf, "events").groupBy(C("event_type").alias("name")).agg(((F.count("*") % 97) / 970.0).alias("p"))
    return rnd(stats.holm(p, "name", "p"), "p", "adjusted")


_DD = """, r AS (SELECT account, d, equity, equity / lag(equity) OVER (PARTITION BY account ORDER BY d) - 1 AS ret, max(equity) OVER (PARTITION BY account ORDER BY d) AS peak FROM curve), dd AS (SELECT *, equity / peak - 1 AS depth FROM r),
    e AS (SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY d) AS k FROM dd), u AS (SELECT *, row_number() OVER (PARTITION BY account, k ORDER BY d) - 1 AS under FROM e)"""


@query("e07_performance", _DD + """ SELECT account, count(ret) AS n, round(arg_max(equity, d) / arg_min(equity, d) - 1, 6) AS total_return, round(stddev_samp(ret) * sqrt(252), 6) AS volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(min(depth), 6) AS max_drawdown, max(under) AS longest_under_water, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END), 6) AS win_rate,
    round(sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0), 6) AS profit_factor FROM u GROUP BY account""", "curve")
def e07(spark, sf):
    p = stats.performance(views.curve(spark, sf), ACC, "d", "equity")
    p = p.select("account", "n", "total_return", "volatility", "sharpe", "max_drawdown", "longest_under_water", "win_rate", "profit_factor")
    return rnd(p, "total_return", "volatility", "sharpe", "max_drawdown", "win_rate", "profit_factor")


@query("e07_performance_tests", None)
def e07b(spark, sf):
    return stats.performance(views.curve(spark, sf), ACC, "d", "equity").select("account", "psr", "sortino", "cagr")


# A schedule of yearly rates by their first day.
RATES = [("1992-03-01", 0.03), ("1994-07-15", 0.045), ("1996-02-20", 0.0525), ("1998-09-01", 0.05)]
_ACCOUNTS = "WITH " + _SUP + """, t AS (SELECT l_suppkey AS sid, (l_discount - 0.05) * l_extendedprice AS pnl FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT l_suppkey AS sid, sum(l_extendedprice) AS notional, sum(l_tax * l_quantity) AS fees, sum(l_tax) AS taxes, sum(l_discount) AS slippage, sum(l_quantity) AS carry FROM lineitem GROUP BY 1),
    pt AS (SELECT sid, d, close AS equity, CASE WHEN sid % 4 <> 1 THEN volume + 1 END AS benchmark, (volume % 50) / 50.0 AS gross, (volume % 30) / 60.0 AS net, row_number() OVER w AS n, lag(close) OVER w AS was, lag(d) OVER w AS from_, max(close) OVER (PARTITION BY sid ORDER BY d) AS peak FROM li WINDOW w AS (PARTITION BY sid ORDER BY d)),
    rt(d0, rate) AS (VALUES """ + ", ".join(f"(DATE '{d}', {r})" for d, r in RATES) + """), x AS (SELECT pt.*, equity / was - 1 AS ret, rate FROM pt ASOF LEFT JOIN rt ON pt.from_ >= rt.d0),
    y AS (SELECT *, ret - rate * date_diff('day', from_, d) / 365 AS excess, equity / peak - 1 AS depth, max(CASE WHEN equity = peak THEN n END) OVER (PARTITION BY sid ORDER BY d) AS top FROM x),
    lw AS (SELECT sid, arg_min(n, (depth, n)) AS ln, arg_min(peak, (depth, n)) AS lp, min(depth) AS ld FROM y GROUP BY sid), bk AS (SELECT y.sid, min(n) FILTER (n > ln AND equity >= lp) - any_value(ln) AS recovery FROM y JOIN lw USING (sid) WHERE ld < 0 GROUP BY y.sid),
    g AS (SELECT sid, count(ret) AS k, count(*) AS points, arg_min(equity, d) AS f, arg_max(equity, d) AS l, date_diff('day', min(d), max(d)) AS days, stddev_samp(ret) AS sd, count(excess) AS covered, avg(excess) AS ex, sqrt(sum(CASE WHEN excess < 0 THEN excess * excess ELSE 0 END) / count(ret)) AS down, min(depth) AS max_drawdown, max(n - top) AS longest,
        count(benchmark) AS b, arg_min(benchmark, d) AS b0, arg_max(benchmark, d) AS b1, avg(equity) AS average, avg(gross) AS average_gross, max(gross) AS maximum_gross, avg(net) AS average_net, avg(ret) AS mu, avg(ret * ret) AS m2, avg(ret * ret * ret) AS m3, avg(ret * ret * ret * ret) AS m4 FROM y GROUP BY sid),
    tr AS (SELECT sid, count(*) AS trades, avg(CAST(pnl > 0 AS INT)) AS win, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won, -sum(pnl) FILTER (pnl < 0) AS lost FROM t GROUP BY sid),
    h AS (SELECT *, CASE WHEN k > 1 AND covered = k AND sd > 0 THEN ex / sd END AS s, CASE WHEN days >= 365 THEN pow(l / f, 365.0 / days) - 1 END AS cagr, (m3 - 3 * mu * m2 + 2 * mu * mu * mu) / pow(m2 - mu * mu, 1.5) AS g3, (m4 - 4 * mu * m3 + 6 * mu * mu * m2 - 3 * mu * mu * mu * mu) / pow(m2 - mu * mu, 2) AS g4 FROM g LEFT JOIN tr USING (sid) LEFT JOIN c USING (sid) LEFT JOIN bk USING (sid))
    SELECT sid, round(l / f - 1, 6) AS total_return, round(cagr, 6) AS cagr, round(sd * sqrt(252), 6) AS volatility, round(s * sqrt(252), 6) AS sharpe, round(sqrt(252 * greatest(0, (1 - g3 * s + (g4 - 1) / 4 * s * s) / (k - 1))), 5) AS sharpe_error, round(CASE WHEN k > 1 AND covered = k AND down > 0 THEN ex / down * sqrt(252) END, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(CASE WHEN max_drawdown < 0 THEN cagr / -max_drawdown END, 6) AS calmar,
    round(notional / average, 6) AS turnover, longest AS longest_drawdown, recovery, round(CASE WHEN b = points THEN b1 / b0 - 1 END, 6) AS benchmark_return, round(l / f - CASE WHEN b = points THEN b1 / b0 END, 6) AS excess_return, trades AS trade_count, round(win, 6) AS win_rate, round(won / lost, 6) AS profit_factor, round(average_gross, 6) AS average_gross, round(maximum_gross, 6) AS maximum_gross, round(average_net, 6) AS average_net,
    round(fees, 4) AS total_fees, round(taxes, 4) AS total_taxes, round(slippage, 4) AS total_slippage, round(carry, 4) AS total_carry, CASE WHEN s IS NULL THEN CASE WHEN covered <> k THEN 'base_rate_not_covered' ELSE 'zero_return_variance' END END AS sharpe_reason, CASE WHEN recovery IS NULL THEN 'not_recovered' END AS recovery_reason, CASE WHEN b <> points THEN 'benchmark_not_available' END AS benchmark_return_reason FROM h"""


def accounts(spark, sf):
    """Suppliers as accounts: points, closed trades, costs, rates."""
    li = views.read(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "sid")
    b = li.groupBy("sid", C("l_shipdate").cast("date").alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("equity"), F.sum("l_quantity").alias("volume"))
    points = b.select("sid", "d", "equity", F.when(C("sid") % 4 != 1, C("volume") + 1).alias("benchmark"), (C("volume") % 50 / 50).alias("gross"), (C("volume") % 30 / 60).alias("net"))
    trades = li.where("l_returnflag = 'A'").select("sid", ((C("l_discount") - 0.05) * C("l_extendedprice")).alias("pnl"))
    costs = li.select("sid", C("l_extendedprice").alias("notional"), (C("l_tax") * C("l_quantity")).alias("fees"), C("l_tax").alias("taxes"), C("l_discount").alias("slippage"), C("l_quantity").alias("carry"))
    rates = spark.createDataFrame(RATES, "d string, rate double").withColumn("d", C("d").cast("date"))
    return points, trades, costs, rates


@query("e07_metrics", _ACCOUNTS)
def e07_all(spark, sf):
    m = measures.metrics(*accounts(spark, sf), "sid").drop("probabilistic_sharpe")
    keep = ["sharpe_reason", "recovery_reason", "benchmark_return_reason"]
    m = m.select(*[c for c in m.columns if not c.endswith("_reason") or c in keep])
    whole = ["sid", "longest_drawdown", "recovery", "trade_count", *keep, "total_fees", "total_taxes", "total_slippage", "total_carry", "sharpe_error"]
    m = rnd(m, *[c for c in m.columns if c not in whole])
    return rnd(rnd(m, "total_fees", "total_taxes", "total_slippage", "total_carry", places=4), "sharpe_error", places=5)


@query("e08_drawdown", _DD + " SELECT account, d, round(depth, 6) AS depth, under AS under_water FROM u", "curve")
def e08(spark, sf):
    return rnd(stats.drawdown(views.curve(spark, sf), ACC, "d", "equity").select("account", "d", "depth", "under_water"), "depth")


_LC = ", c AS (SELECT sid, d, close FROM long_bars)"


def long_curve(spark, sf):
    return views.long_bars(spark, sf).select("sid", "d", "close")


@query("e09_monthly_returns", _LC + ", m AS (SELECT sid, CAST(date_trunc('month', d) AS DATE) AS month, arg_max(close, d) AS e, arg_min(close, d) AS f FROM c GROUP BY ALL) SELECT sid, month, round(e / coalesce(lag(e) OVER (PARTITION BY sid ORDER BY month), f) - 1, 6) AS ret FROM m", "long_bars")
def e09(spark, sf):
    return rnd(stats.monthly_returns(long_curve(spark, sf), ["sid"], "d", "close"), "ret")


@query("e09_rolling_sharpe", _LC + ", r AS (SELECT sid, d, close / lag(close) OVER (PARTITION BY sid ORDER BY d) - 1 AS ret FROM c) SELECT sid, d, CASE WHEN count(ret) OVER w = 20 THEN round(avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) * sqrt(252), 5) END AS sharpe FROM r WINDOW w AS (PARTITION BY sid ORDER BY d ROWS 19 PRECEDING)", "long_bars")
def e09b(spark, sf):
    return rnd(stats.rolling_sharpe(long_curve(spark, sf), ["sid"], "d", "close", 20), "sharpe", places=5)


@query("e10_excess_returns", """, rates AS (SELECT DISTINCT CAST(date_trunc('week', d) AS DATE) AS d, (day(date_trunc('week', d)) % 5) / 100.0 AS rate FROM curve), r AS (SELECT account, d, equity / lag(equity) OVER w - 1 AS ret, date_diff('day', lag(d) OVER w, d) AS days FROM curve WINDOW w AS (PARTITION BY account ORDER BY d))
    SELECT r.account, r.d, round(ret - rate * days / 365, 8) AS excess FROM r ASOF LEFT JOIN rates ON r.d >= rates.d""", "curve")
def e10(spark, sf):
    c = views.curve(spark, sf)
    week = F.date_trunc("week", "d").cast("date")
    rates = c.select(week.alias("d"), ((F.dayofmonth(week) % 5) / 100.0).alias("rate")).distinct()
    return rnd(stats.excess_returns(c, rates, ACC, "d", "equity"), "excess", places=8)


@query("e11_deflated_sharpe", None)
def e11(spark, sf):
    r = stats.with_returns(views.long_bars(spark, sf), ["sid"], "d", "close").groupBy("sid").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"), F.count("ret").alias("n_obs"))
    return stats.deflated_sharpe(r, "sharpe", "n_obs")


@query("e12_trial_ledger", """SELECT o_orderkey, CASE WHEN fin IS NULL THEN 'pending' WHEN row_number() OVER (PARTITION BY o_custkey, fin IS NULL ORDER BY fin, o_orderkey) = 1 THEN 'counted' ELSE 'recheck' END AS role FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS fin FROM orders)""")
def e12(spark, sf):
    o = views.read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(C("o_orderstatus") != "O", C("o_orderdate")).alias("fin"))
    return stats.trial_ledger(o, ["o_custkey"], "fin", "o_orderkey").select("o_orderkey", "role")


@query("e13_lineage_root", """WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 9), up AS (SELECT child AS node, child AS pos, 0 AS n FROM e UNION ALL SELECT u.node, e.parent, u.n + 1 FROM up u JOIN e ON u.pos = e.child) SELECT node, arg_max(pos, n) AS root FROM up GROUP BY node""")
def e13(spark, sf):
    c = views.read(spark, sf, "customer").where("c_custkey > 9").select(C("c_custkey").alias("child"), F.expr("c_custkey div 3").alias("parent"))
    return stats.lineage_root(spark, c)


_CELLS = "WITH cells AS (SELECT l_linenumber AS a, month(l_shipdate) AS b, avg(l_discount) AS score FROM lineitem GROUP BY ALL)"


def cells(spark, sf):
    return views.read(spark, sf, "lineitem").groupBy(C("l_linenumber").alias("a"), F.month("l_shipdate").alias("b")).agg(F.avg("l_discount").alias("score"))


@query("e14_parameter_grid", "SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, n FROM (SELECT unnest([0.1, 0.2, 0.3]) AS a) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS b) CROSS JOIN (SELECT count(*) AS n FROM region) WHERE a * b < 0.85")
def e14(spark, sf):
    n = views.read(spark, sf, "region").agg(F.count("*").alias("n"))
    return stats.parameter_grid(spark, {"a": (0.1, 0.3, 0.1), "b": (1.0, 4.0, 1.0)}, "a * b < 0.85").join(F.broadcast(n))


_AXES = "ax AS (SELECT c_nationkey AS g, c_mktsegment AS axis, CAST(floor(min(c_acctbal) / 1000) AS DECIMAL(18,2)) AS lo, CAST(floor(min(c_acctbal) / 1000) + count(*) % 3 AS DECIMAL(18,2)) AS hi, CASE WHEN count(*) % 11 = 4 THEN 0 ELSE CAST(0.5 + count(*) % 2 * 0.5 AS DECIMAL(18,2)) END AS step FROM customer GROUP BY ALL)"


@query("e14_grids_of_tables", "WITH " + _AXES + """, n AS (SELECT *, CASE WHEN step > 0 THEN CAST(floor((hi - lo) / step) AS BIGINT) + 1 ELSE 0 END AS n FROM ax), s AS (SELECT g, min(n) AS least, CAST(product(n) AS BIGINT) AS size FROM n GROUP BY g)
    SELECT g, CASE WHEN least = 0 THEN 'empty_axis' WHEN size > 500 THEN 'too_many_cells' ELSE 'ok' END AS status, CASE WHEN least = 0 OR size > 500 THEN 1 ELSE size END AS cells FROM s""")
def e14_tables(spark, sf):
    c = views.read(spark, sf, "customer").groupBy(C("c_nationkey").alias("g"), C("c_mktsegment").alias("axis")).agg(F.floor(F.min("c_acctbal") / 1000).cast("decimal(18,2)").alias("lo"), F.count("*").alias("n"))
    axes = c.select("g", "axis", "lo", (C("lo") + C("n") % 3).cast("decimal(18,2)").alias("hi"), F.when(C("n") % 11 == 4, 0).otherwise(0.5 + C("n") % 2 * 0.5).cast("decimal(18,2)").alias("step"))
    return measures.grids(axes, ["g"], 500).groupBy("g", "status").agg(F.count("*").alias("cells"))


_PARAMS = "pm AS (SELECT p_partkey AS id, unnest(['price', 'size']) AS axis, unnest([CAST(p_retailprice / 1000 AS DECIMAL(18,2)), CAST(p_size AS DECIMAL(18,2))]) AS cur, unnest([CAST(0.5 AS DECIMAL(18,2)), 1]) AS lo, unnest([CAST(2 AS DECIMAL(18,2)), 50]) AS hi, unnest([NULL, CAST(3 AS DECIMAL(18,2))]) AS step FROM part)"


@query("e21_robustness_axes", "WITH " + _PARAMS + ", dl AS (SELECT *, coalesce(step, cur * 0.2) AS delta FROM pm), v AS (SELECT id, axis, lo, hi, unnest([-1, 0, 1]) AS k, cur, delta FROM dl), x AS (SELECT id, axis, CASE WHEN axis = 'size' THEN floor(cur + k * delta) ELSE cur + k * delta END AS v FROM v WHERE cur + k * delta BETWEEN lo AND hi) SELECT id, axis, count(DISTINCT v) AS n, round(CAST(min(v) AS DOUBLE), 6) AS least, round(CAST(max(v) AS DOUBLE), 6) AS most FROM x GROUP BY ALL")
def e21_axes(spark, sf):
    a = measures.robustness_axes(parameters(spark, sf), ["id"])
    return rnd(a.where(F.size("values") > 0).select("id", "axis", F.size("values").cast("long").alias("n"), F.array_min("values").alias("least"), F.array_max("values").alias("most")), "least", "most")


def parameters(spark, sf):
    """Two numbers of each part: a price without a step, a whole size with steps of three."""
    p = views.read(spark, sf, "part")
    row = lambda axis, cur, lo, hi, step, whole: F.struct(F.lit(axis).alias("axis"), cur.cast("decimal(18,2)").alias("current"), F.lit(lo).cast("decimal(18,2)").alias("lo"), F.lit(hi).cast("decimal(18,2)").alias("hi"), F.lit(step).cast("decimal(18,2)").alias("step"), F.lit(whole).alias("whole"))
    return p.select(C("p_partkey").alias("id"), F.explode(F.array(row("price", C("p_retailprice") / 1000, 0.5, 2, None, False), row("size", C("p_size"), 1, 50, 3, True))).alias("x")).select("id", "x.*")


@query("e21_robustness_split", "SELECT o_custkey AS id, CAST(min(o_orderdate) AS DATE) AS \"start\", CAST(max(o_orderdate) AS DATE) AS \"end\", CASE WHEN CAST(CAST(min(o_orderdate) AS DATE) + INTERVAL 4 YEAR AS DATE) - 15 <= CAST(max(o_orderdate) AS DATE) THEN 3 WHEN CAST(CAST(min(o_orderdate) AS DATE) + INTERVAL 3 YEAR AS DATE) - 15 <= CAST(max(o_orderdate) AS DATE) THEN 2 WHEN CAST(CAST(min(o_orderdate) AS DATE) + INTERVAL 2 YEAR AS DATE) - 15 <= CAST(max(o_orderdate) AS DATE) THEN 1 END AS train_years FROM orders GROUP BY 1")
def e21_split(spark, sf):
    o = views.read(spark, sf, "orders").groupBy(C("o_custkey").alias("id")).agg(F.min(C("o_orderdate").cast("date")).alias("start"), F.max(C("o_orderdate").cast("date")).alias("end"))
    return measures.robustness_split(o)


@query("e15_neighbor_mean", _CELLS + ", m AS (SELECT x.a, x.b, x.score, avg(y.score) AS neighbor_mean, count(*) AS n FROM cells x JOIN cells y ON abs(x.a - y.a) <= 1 AND abs(x.b - y.b) <= 1 GROUP BY ALL) SELECT a, b, round(score, 6) AS score, round(neighbor_mean, 6) AS neighbor_mean, n FROM m")
def e15(spark, sf):
    return rnd(stats.neighbor_mean(cells(spark, sf), ["a", "b"], "score").drop("neighbor_rank"), "score", "neighbor_mean")


@query("e16_plateau_map", _CELLS + ", c2 AS (SELECT a, b, CASE WHEN (a + b) % 6 <> 0 THEN score END AS score FROM cells), s AS (SELECT * FROM c2 WHERE score IS NOT NULL), m AS (SELECT x.a, x.b, x.score, avg(y.score) AS nm FROM s x JOIN s y ON abs(x.a - y.a) <= 1 AND abs(x.b - y.b) <= 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY nm DESC, a, b) AS k FROM m) SELECT a, b, round(score, 6) AS score, round(nm, 6) AS neighbor_mean, CASE WHEN nm < 0.99 * score THEN 'peak' WHEN k = 1 THEN 'recommended' ELSE 'plain' END AS verdict FROM r UNION ALL SELECT a, b, score, NULL, 'failed' FROM c2 WHERE score IS NULL")
def e16(spark, sf):
    c = cells(spark, sf).withColumn("score", F.when((C("a") + C("b")) % 6 != 0, C("score")))
    return rnd(stats.plateau_map(c, ["a", "b"], "score", 0.99), "score", "neighbor_mean")


@query("e17_walk_forward", ", n AS (SELECT max(idx) + 1 AS n FROM calendar), s AS (SELECT unnest(range(0, n - 17 + 1, 5)) AS s FROM n) SELECT row_number() OVER (ORDER BY s) - 1 AS window, s AS train_from, s + 9 AS train_to, s + 12 AS test_from, s + 16 AS test_to FROM s", "calendar")
def e17(spark, sf):
    return stats.walk_forward(views.calendar(views.bars(spark, sf)), 10, 5, 2, False)


@query("e18_capacity_limit", _CELLS + ", x AS (SELECT b, max(score) AS s FROM cells GROUP BY b), y AS (SELECT b, s, max(s) OVER (ORDER BY b) AS best FROM x) SELECT min(b) AS \"limit\" FROM y WHERE s < 0.98 * best")
def e18(spark, sf):
    x = cells(spark, sf).groupBy("b").agg(F.max("score").alias("s"))
    return stats.capacity_limit(x, "b", "s", 0.98)


@query("e19_market_reference", ", i AS (SELECT d, sum(close * volume) / sum(volume) AS close FROM panel GROUP BY d) SELECT d, round(close / first_value(close) OVER (ORDER BY d) * 1000, 6) AS equity, true AS complete FROM i", "panel")
def e19(spark, sf):
    p = views.panel(spark, sf)
    i = p.groupBy("d").agg((F.sum(C("close") * C("volume")) / F.sum("volume")).alias("close"))
    return rnd(stats.market_reference(i, views.calendar(views.bars(spark, sf)), "d", "close", 1000.0), "equity")


@query("e20_regime_breakdown", ", r AS (SELECT account, d, equity / lag(equity) OVER (PARTITION BY account ORDER BY d) - 1 AS ret, day(d) % 3 AS regime FROM curve) SELECT account, regime, count(*) AS n, round(product(1 + ret) - 1, 8) AS ret FROM r WHERE ret IS NOT NULL GROUP BY ALL", "curve")
def e20(spark, sf):
    r = stats.with_returns(views.curve(spark, sf), ACC, "d", "equity").withColumn("regime", F.dayofmonth("d") % 3)
    return rnd(stats.regime_breakdown(r, ACC, "regime", "ret"), "ret", places=8)


@query("e21_robustness_grid", "SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, n FROM (SELECT unnest([8, 10, 12]) AS a) CROSS JOIN (SELECT unnest([4, 5, 6]) AS b) CROSS JOIN (SELECT count(*) AS n FROM nation)")
def e21(spark, sf):
    n = views.read(spark, sf, "nation").agg(F.count("*").alias("n"))
    return stats.parameter_grid(spark, {"a": (8.0, 12.0, 2.0), "b": (4.0, 6.0, 1.0)}).join(F.broadcast(n))


@query("e22_selection_schedule", """, picks AS (SELECT next_d AS d, idx % 4 AS candidate FROM calendar WHERE idx % 6 = 0 AND next_d IS NOT NULL) SELECT c.d, p.candidate, p.d AS d_matched FROM calendar c ASOF LEFT JOIN picks p ON c.d >= p.d""", "calendar")
def e22(spark, sf):
    cal = views.calendar(views.bars(spark, sf))
    one = F.lit(1).alias("k")
    picks = cal.where("idx % 6 = 0 AND next_d IS NOT NULL").select(one, C("next_d").alias("d"), (C("idx") % 4).alias("candidate"))
    return joins.asof_backward(cal.select(one, "d"), picks, ["k"], "d", ["candidate"]).select("d", "candidate", "d_matched")


@query("e23_account_summary", "SELECT account, count(*) AS n, round(arg_max(equity, d), 6) AS last, round(arg_max(equity, d) / 100000 - 1, 6) AS return, 'ok' AS status FROM curve GROUP BY account", "curve")
def e23(spark, sf):
    return rnd(stats.account_summary(views.curve(spark, sf), ACC, "d", "equity", 100000.0), "last", "return")


@query("e24_performance_window", ", w AS (SELECT account, d, equity FROM curve WHERE d >= coalesce((SELECT max(d) FROM curve WHERE d < DATE '2024-01-10'), DATE '2024-01-10') AND d <= DATE '2024-01-20') SELECT account, count(*) - 1 AS n, round(arg_max(equity, d) / arg_min(equity, d) - 1, 6) AS total_return FROM w GROUP BY account", "curve")
def e24(spark, sf):
    c = views.curve(spark, sf)
    lo, hi = F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")
    base = c.where(C("d") < lo).agg(F.max("d").alias("base"))
    w = c.join(F.broadcast(base)).where((C("d") >= F.coalesce("base", lo)) & (C("d") <= hi))
    return rnd(stats.performance(w, ACC, "d", "equity").select("account", "n", "total_return"), "total_return")


@query("e19_reference_curves", """, i AS (SELECT sid, d, idx, close FROM panel p JOIN calendar c USING (d, idx) WHERE NOT (sid % 3 = 1 AND idx % 7 = 3)), g AS (SELECT sid, max(idx) - min(idx) + 1 - count(*) FILTER (close > 0) AS gaps FROM i GROUP BY sid)
    SELECT i.sid, d, round(close / first_value(close) OVER (PARTITION BY i.sid ORDER BY d) * 1000, 6) AS equity, NULL AS reason FROM i JOIN g USING (sid) WHERE gaps = 0 UNION ALL SELECT sid, NULL, NULL, 'gaps:' || gaps FROM g WHERE gaps > 0""", "panel")
def e19_curves(spark, sf):
    p = views.panel(spark, sf).where("NOT (sid % 3 = 1 AND idx % 7 = 3)").select("sid", "d", "close")
    return rnd(stats.reference_curves(p, views.calendar(views.bars(spark, sf)), "sid", "d", "close", 1000.0), "equity")


@query("e20_weekly_returns", "WITH " + _SUP + ", w AS (SELECT sid, CAST(date_trunc('week', d) AS DATE) AS week, arg_max(close, d) AS e, arg_min(close, d) AS f, count(*) AS sessions FROM li GROUP BY ALL) SELECT sid, week, round(e / coalesce(lag(e) OVER (PARTITION BY sid ORDER BY week), f) - 1, 6) AS ret, sessions FROM w")
def e20_weekly(spark, sf):
    return rnd(stats.weekly_returns(views.long_bars(spark, sf), ["sid"], "d", "close"), "ret")


@query("e24_window_metrics", "WITH " + _SUP + """, pt AS (SELECT sid, d, close, (volume % 50) / 50.0 AS gross FROM li), b AS (SELECT sid, arg_max(close, d) AS base FROM pt WHERE d < DATE '1995-01-01' GROUP BY sid), w AS (SELECT sid, arg_min(close, d) AS f, arg_max(close, d) AS l, avg(close) AS average, avg(gross) AS average_gross FROM pt WHERE d BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' GROUP BY sid),
    t AS (SELECT l_suppkey AS sid, count(*) AS trades, avg(CAST(l_discount > 0.05 AS INT)) AS win FROM lineitem WHERE l_returnflag = 'A' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' GROUP BY 1), c AS (SELECT l_suppkey AS sid, sum(l_extendedprice) AS notional, sum(l_tax * l_quantity) AS fees FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' GROUP BY 1)
    SELECT sid, round(l / coalesce(base, f) - 1, 6) AS total_return, round(notional / average, 5) AS turnover, coalesce(trades, 0) AS trade_count, round(win, 6) AS win_rate, round(average_gross, 6) AS average_gross, round(fees, 4) AS total_fees FROM w LEFT JOIN b USING (sid) LEFT JOIN t USING (sid) LEFT JOIN c USING (sid)""")
def e24_window(spark, sf):
    points, _, _, rates = accounts(spark, sf)
    li = views.read(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "sid").withColumn("d", C("l_shipdate").cast("date"))
    trades = li.where("l_returnflag = 'A'").select("sid", "d", ((C("l_discount") - 0.05) * C("l_extendedprice")).alias("pnl"))
    costs = li.select("sid", "d", C("l_extendedprice").alias("notional"), (C("l_tax") * C("l_quantity")).alias("fees"), C("l_tax").alias("taxes"), C("l_discount").alias("slippage"), C("l_quantity").alias("carry"))
    m = measures.window_metrics(points, trades, costs, rates, "sid", "1995-01-01", "1996-06-30")
    m = m.select("sid", "total_return", "turnover", "trade_count", "win_rate", "average_gross", "total_fees")
    return rnd(rnd(rnd(m, "total_return", "win_rate", "average_gross"), "turnover", places=5), "total_fees", places=4)
