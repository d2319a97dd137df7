"""Portfolios, risk and market reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins, market, technical

from . import views
from .q_streams import LEVELS_SQL
from .registry import query

C = F.col


def rnd(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else C(c) for c in df.columns])


def scored(spark, sf):
    p = views.panel(spark, sf)
    return p.select("d", "idx", "sid", "sector", C("close").alias("score"), C("volume").alias("tie"), (C("high") - C("low") + 1).alias("risk"), "amount")


_SC = ", s AS (SELECT d, idx, sid, sector, close AS score, volume AS tie, high - low + 1 AS risk, amount FROM panel)"
_SEL = _SC + ", t AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, tie DESC, sid) AS hi, row_number() OVER (PARTITION BY d ORDER BY score, tie DESC, sid) AS lo FROM s), sel AS (SELECT *, CASE WHEN hi <= 4 THEN 'long' ELSE 'short' END AS side, CASE WHEN hi <= 4 THEN hi ELSE lo END AS rank FROM t WHERE hi <= 4 OR lo <= 2)"


def selected(spark, sf):
    return market.select_names(scored(spark, sf), ["d"], "score", "tie", "sid", 4)


_LONG = _SC + ", sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, tie DESC, sid) AS rank FROM s) WHERE rank <= 4)"


@query("b01_composite_signal", ", r AS (SELECT sid, d, (rank() OVER (PARTITION BY d ORDER BY close) + (count(*) OVER (PARTITION BY d, close) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY d) - 1, 1) AS a, CASE WHEN stddev_pop(amount) OVER (PARTITION BY d) = 0 THEN 0.0 ELSE -(amount - avg(amount) OVER (PARTITION BY d)) / stddev_pop(amount) OVER (PARTITION BY d) END AS b FROM panel) SELECT sid, d, round(0.7 * a + 0.3 * b, 6) AS score FROM r", "panel")
def b01(spark, sf):
    from tidemark.functions import ranks
    from tidemark.operators.aggregates import weighted_available

    p = views.panel(spark, sf).select("sid", "d", ranks.rank_avg(["d"], C("close")).alias("a"), (-ranks.zscore_pop(["d"], C("amount"))).alias("b"))
    return p.select("sid", "d", F.round(weighted_available({"a": 0.7, "b": 0.3}), 6).alias("score"))


@query("b02_select_names", _SEL + " SELECT d, sid, side, rank FROM sel", "panel")
def b02(spark, sf):
    both = market.select_names(scored(spark, sf), ["d"], "score", "tie", "sid", 4).select("d", "sid", "side", "rank")
    return both.unionByName(_shorts(spark, sf))


def _shorts(spark, sf):
    s = scored(spark, sf)
    w = Window.partitionBy("d")
    s = s.withColumn("hi", F.row_number().over(w.orderBy(F.desc("score"), F.desc("tie"), "sid"))).withColumn("lo", F.row_number().over(w.orderBy("score", F.desc("tie"), "sid")))
    return s.where("hi > 4 AND lo <= 2").select("d", "sid", F.lit("short").alias("side"), C("lo").alias("rank"))


for _m, _raw in {"equal": "1.0", "score": "score", "rank": "max(rank) OVER (PARTITION BY d) + 1.0 - rank", "inverse_risk": "1.0 / risk"}.items():

    @query(f"b03_weights_{_m}", _LONG + f", r AS (SELECT d, sid, {_raw} AS raw FROM sel) SELECT d, sid, round(raw / nullif(sum(raw) OVER (PARTITION BY d), 0), 6) AS weight FROM r", "panel")
    def b03(spark, sf, m=_m):
        return market.weights(selected(spark, sf), ["d"], m).select("d", "sid", F.round("weight", 6).alias("weight"))


@query("b04_cap_weights", _LONG + ", w0 AS (SELECT d, sid, score / nullif(sum(score) OVER (PARTITION BY d), 0) AS w FROM sel)" + "".join(f", c{i} AS (SELECT d, sid, w, least(w, 0.3) AS c FROM w{i}), w{i + 1} AS (SELECT d, sid, CASE WHEN c < 0.3 AND sum(CASE WHEN c < 0.3 THEN c ELSE 0 END) OVER (PARTITION BY d) > 0 THEN c + sum(w - c) OVER (PARTITION BY d) * c / sum(CASE WHEN c < 0.3 THEN c ELSE 0 END) OVER (PARTITION BY d) ELSE c END AS w FROM c{i})" for i in range(4)) + " SELECT d, sid, round(least(w, 0.3), 6) AS weight FROM w4", "panel")
def b04(spark, sf):
    w = market.weights(selected(spark, sf), ["d"], "score").select("d", "sid", "weight")
    return market.cap_weights(w, ["d"], 0.3, 4).select("d", "sid", F.round("weight", 6).alias("weight"))


@query("b05_rebalance_dates", ", r AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('week', d) ORDER BY d DESC) AS k FROM calendar) SELECT d AS signal, next_d AS execution FROM r WHERE k = 1 AND next_d IS NOT NULL", "calendar")
def b05(spark, sf):
    return market.rebalance_dates(views.calendar(views.bars(spark, sf)), "week")


@query("b06_buffer_targets", None)
def b06(spark, sf):
    """A portfolio for each user, its targets the shares of the kinds of events in a session's value."""
    e = views.read(spark, sf, "events").withColumn("d", C("ts").cast("date")).join(views.calendar(views.bars(spark, sf)).select("d", "idx"), "d")
    e = e.groupBy(C("user_id").alias("portfolio"), "idx", C("event_type").alias("name")).agg(F.sum(F.abs("value")).alias("v"))
    w = e.withColumn("weight", F.coalesce(F.try_divide(C("v"), F.sum("v").over(Window.partitionBy("portfolio", "idx"))), F.lit(0.0)))
    return market.buffer_targets(w.drop("v"), "portfolio", "idx", "name", "weight", 0.05)


@query("b07_scheduled_targets", _LONG + ", f AS (SELECT idx, sid, rank % 2 AS candidate FROM sel) SELECT idx, sid, candidate FROM f WHERE candidate = (idx // 7) % 2", "panel")
def b07(spark, sf):
    from tidemark.operators.joins import range_join

    f = selected(spark, sf).select(C("idx").cast("long").alias("idx"), "sid", (C("rank") % 2).alias("candidate"))
    windows = f.select(F.expr("idx div 7").alias("w")).distinct().select((C("w") % 2).cast("int").alias("candidate"), (C("w") * 7).alias("lo"), (C("w") * 7 + 6).alias("hi"))
    return range_join(f, windows, ["candidate"], "idx", "lo", "hi").select("idx", "sid", "candidate")


_PLAN = _SC + """, x AS (SELECT idx, sid, row_number() OVER (PARTITION BY idx ORDER BY score DESC, sid) AS rank, sid % 3 = 0 AS held, sid % 5 = 0 AS blocked, CASE WHEN sid % 7 <> 0 THEN score END AS price FROM s),
    k AS (SELECT *, held AND (rank <= 5 OR blocked) AS keep, NOT held AND NOT blocked AND price IS NOT NULL AS can FROM x), p AS (SELECT *, 6 - sum(CAST(keep AS INT)) OVER (PARTITION BY idx) AS free, row_number() OVER (PARTITION BY idx, can ORDER BY rank) AS place FROM k),
    a AS (SELECT idx, sid, CASE WHEN keep THEN 'keep' WHEN held THEN 'sell' WHEN can AND place <= free THEN 'buy' END AS action FROM p)"""


@query("b08_plan_rebalance", _PLAN + " SELECT * FROM a WHERE action IS NOT NULL", "panel")
def b08(spark, sf):
    s = scored(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("score"), "sid")))
    s = s.withColumn("held", C("sid") % 3 == 0).withColumn("blocked", C("sid") % 5 == 0).withColumn("price", F.when(C("sid") % 7 != 0, C("score")))
    return market.plan_rebalance(s, ["idx"], 6, 5).select("idx", "sid", "action")


@query("b09_scaled_targets", _LONG + " SELECT d, sid FROM sel WHERE rank <= CASE WHEN idx % 3 = 0 THEN 2 ELSE 4 END", "panel")
def b09(spark, sf):
    return selected(spark, sf).where(C("rank") <= F.when(C("idx") % 3 == 0, 2).otherwise(4)).select("d", "sid")


@query("b10_signal_anomalies", _SC + " SELECT a.idx, count(*) AS n, count(*) FILTER (b.sid IS NULL) AS gone FROM s a LEFT JOIN s b ON b.idx = a.idx + 1 AND b.sid = a.sid GROUP BY a.idx", "panel")
def b10(spark, sf):
    s = scored(spark, sf).select("idx", "sid")
    nxt = s.select((C("idx") - 1).alias("idx"), "sid", F.lit(1).alias("there"))
    return s.join(nxt, ["idx", "sid"], "left").groupBy("idx").agg(F.count("*").alias("n"), F.count_if(C("there").isNull()).alias("gone"))


@query("b11_execution_quality", "SELECT sid % 5 AS k, round(sum(least(volume, 3) * (close - open) * CASE WHEN sid % 2 = 0 THEN 1 ELSE -1 END) / nullif(sum(least(volume, 3) * open), 0) * 10000, 4) AS shortfall_bp, round(sum((volume - least(volume, 3)) * open), 6) AS missed FROM panel GROUP BY 1", "panel")
def b11(spark, sf):
    f = views.panel(spark, sf).select((C("sid") % 5).alias("k"), F.least("volume", F.lit(3)).alias("filled"), C("volume").alias("wanted"), C("close").alias("price"), C("open").alias("decision"), F.when(C("sid") % 2 == 0, "buy").otherwise("sell").alias("side"))
    return market.execution_quality(f, ["k"]).select("k", F.round("shortfall_bp", 4).alias("shortfall_bp"), F.round("missed", 6).alias("missed"))


@query("b12_guard_targets", _LONG + """, w AS (SELECT d, sid, score / nullif(sum(score) OVER (PARTITION BY d), 0) AS weight, sid % 9 = 0 AS halted, sid % 8 = 0 AS blocked, amount AS adv FROM sel)
    SELECT d, sid, round(CASE WHEN halted OR blocked THEN 0 ELSE least(weight, 0.3, adv * 0.01) END, 6) AS target, concat_ws(',', CASE WHEN halted THEN 'halted' END, CASE WHEN blocked THEN 'blocked' END, CASE WHEN weight > 0.3 THEN 'weight_cap' END, CASE WHEN weight > adv * 0.01 THEN 'adv_cap' END) AS reasons FROM w""", "panel")
def b12(spark, sf):
    w = market.weights(selected(spark, sf), ["d"], "score").select("d", "sid", "weight", (C("sid") % 9 == 0).alias("halted"), (C("sid") % 8 == 0).alias("blocked"), C("amount").alias("adv"))
    return market.guard_targets(w, 0.3, 0.01).select("d", "sid", F.round("target", 6).alias("target"), "reasons")


@query("b13_check_orders", "SELECT sid, d, CASE WHEN sid % 9 = 0 THEN 'halted' WHEN close >= open * 1.29 THEN 'near_limit' WHEN volume < 2 THEN 'thin' END AS problem FROM panel", "panel")
def b13(spark, sf):
    from tidemark.operators.universe import first_failing

    rules = [("halted", C("sid") % 9 != 0), ("near_limit", C("close") < C("open") * 1.29), ("thin", C("volume") >= 2)]
    return views.panel(spark, sf).select("sid", "d", first_failing(rules).alias("problem"))


@query("b14_session_holdings", """, h AS (SELECT coalesce(a.sid, b.sid) AS sid, coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.volume, 0) AS volume, coalesce(b.volume, 0) AS before FROM panel a FULL JOIN panel b ON a.sid = b.sid AND a.idx = b.idx + 1)
    SELECT sid, idx, volume, CASE WHEN volume = 0 THEN 'closed' WHEN before = 0 THEN 'new' WHEN volume > before THEN 'added' WHEN volume < before THEN 'reduced' ELSE 'unchanged' END AS change FROM h WHERE idx <= (SELECT max(idx) FROM panel)""", "panel")
def b14(spark, sf):
    return market.session_holdings(views.panel(spark, sf), ["sid"], "idx", "volume")


@query("b15_closed_trades", None)
def b15(spark, sf):
    e = views.read(spark, sf, "events")
    f = e.select(C("user_id").alias("sid"), "event_id", F.when(C("event_id") % 3 == 0, -2.0).otherwise(1.0).alias("qty"), C("value").alias("price"))
    return market.closed_trades(f, "sid", "event_id", "qty", "price", 0.001)


@query("b16_portfolio_returns", _LONG + ", r AS (SELECT sid, idx, close / nullif(open, 0) - 1 AS ret FROM panel), j AS (SELECT s.idx, 0.25 AS w, r.ret FROM sel s LEFT JOIN r USING (sid, idx)) SELECT idx, round(CASE WHEN bool_and(coalesce(ret IS NOT NULL AND abs(ret) <= 3, false)) THEN sum(w * ret) END, 6) AS ret, count(*) AS names FROM j GROUP BY idx", "panel")
def b16(spark, sf):
    w = selected(spark, sf).select("idx", "sid", F.lit(0.25).alias("weight"))
    r = views.panel(spark, sf).select("idx", "sid", (F.try_divide("close", "open") - 1).alias("ret"))
    return rnd(market.portfolio_returns(w, r, ["idx"], "sid", 3.0), "ret")


@query("b17_sell_tax", "SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1999-01-01' THEN 0.002 WHEN o_orderdate >= DATE '1996-06-01' THEN 0.0025 WHEN o_orderdate >= DATE '1990-01-01' THEN 0.003 END AS rate FROM orders")
def b17(spark, sf):
    # A schedule of rates by their first day.
    rates = spark.createDataFrame([("1990-01-01", 0.003), ("1996-06-01", 0.0025), ("1999-01-01", 0.002)], "d string, rate double").select(C("d").cast("date").alias("d"), "rate")
    o = views.read(spark, sf, "orders").select("o_orderkey", C("o_orderdate").cast("date").alias("d"))
    return joins.scheduled(o, "d", rates, ["rate"]).select("o_orderkey", "rate")


@query("b18_impact_scale", ", r AS (SELECT sid, idx, close / nullif(lag(close) OVER (PARTITION BY sid ORDER BY idx), 0) - 1 AS ret, amount FROM panel) SELECT sid, idx, CASE WHEN count(ret) OVER w >= 3 THEN round(stddev_samp(ret) OVER w * sqrt(50.0 / avg(amount) OVER w), 6) END AS impact FROM r WINDOW w AS (PARTITION BY sid ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)", "panel")
def b18(spark, sf):
    w = Window.partitionBy("sid").orderBy("idx")
    p = views.panel(spark, sf).select("sid", "idx", "amount", (F.try_divide(C("close"), F.lag("close").over(w)) - 1).alias("ret"))
    return market.impact_scale(p, ["sid"], "idx", "ret", "amount", 6, 50.0).select("sid", "idx", F.round("impact", 6).alias("impact"))


@query("b19_execution_costs", "SELECT l_suppkey % 10 AS k, round(sum(l_quantity * l_tax) / sum(l_quantity) * 10000, 4) AS cost_bp, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS unfilled, count(DISTINCT (l_suppkey, l_shipdate)) AS sessions FROM lineitem GROUP BY 1")
def b19(spark, sf):
    x = views.read(spark, sf, "lineitem").withColumn("k", C("l_suppkey") % 10)
    g = x.groupBy("k").agg(F.round(F.sum(C("l_quantity") * C("l_tax")) / F.sum("l_quantity") * 10000, 4).alias("cost_bp"), F.round(F.sum(F.when(C("l_linestatus") == "O", C("l_quantity")).otherwise(0)) / F.sum("l_quantity"), 6).alias("unfilled"))
    s = x.select("k", "l_suppkey", "l_shipdate").distinct().groupBy("k").agg(F.count("*").alias("sessions"))
    return g.join(s, "k")


@query("b20_holdings_overview", ", h AS (SELECT sid, idx, idx - row_number() OVER (PARTITION BY sid ORDER BY idx) AS run, amount FROM panel WHERE volume >= 2), p AS (SELECT sid, run, count(*) AS n, sum(amount) AS a FROM h GROUP BY ALL) SELECT sid, count(*) AS periods, max(n) AS longest, round(sum(a), 4) AS amount FROM p GROUP BY sid", "panel")
def b20(spark, sf):
    h = views.panel(spark, sf).where("volume >= 2").withColumn("run", C("idx") - F.row_number().over(Window.partitionBy("sid").orderBy("idx")))
    p = h.groupBy("sid", "run").agg(F.count("*").alias("n"), F.sum("amount").alias("a"))
    return p.groupBy("sid").agg(F.count("*").alias("periods"), F.max("n").alias("longest"), F.round(F.sum("a"), 4).alias("amount"))


# ---- risk

_RET = ", i AS (SELECT d, avg(close) AS ix FROM panel GROUP BY d), r AS (SELECT p.sid, p.idx, p.d, p.close / nullif(lag(p.close) OVER w, 0) - 1 AS ret, i.ix / lag(i.ix) OVER w - 1 AS iret FROM panel p JOIN i USING (d) WINDOW w AS (PARTITION BY sid ORDER BY p.idx))"


def returns(spark, sf):
    p = views.panel(spark, sf)
    i = p.groupBy("d").agg(F.avg("close").alias("ix"))
    w = Window.partitionBy("sid").orderBy("idx")
    return p.join(i, "d").select("sid", "idx", "d", (F.try_divide(C("close"), F.lag("close").over(w)) - 1).alias("ret"), (C("ix") / F.lag("ix").over(w) - 1).alias("iret"))


@query("r01_risk_windows", _RET + ", k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY idx DESC) AS i FROM r), x AS (SELECT *, unnest([5, 15]) AS n FROM k) SELECT sid, n AS window, round(stddev_samp(ret) * sqrt(252), 5) AS volatility, round(regr_slope(ret, iret), 5) AS beta FROM x WHERE i <= n GROUP BY sid, n", "panel")
def r01(spark, sf):
    return rnd(market.risk_windows(returns(spark, sf), ["sid"], "idx", "ret", "iret", [5, 15]), "volatility", "beta", places=5)


@query("r02_tail_stat", _RET + ", k AS (SELECT sid, ret, row_number() OVER (PARTITION BY sid ORDER BY ret) AS i, count(*) OVER (PARTITION BY sid) AS n FROM r WHERE ret IS NOT NULL) SELECT sid, round(avg(ret), 6) AS tail_mean, round(max(ret), 6) AS cutoff, count(*) AS n FROM k WHERE i <= ceil(n * 0.1) GROUP BY sid", "panel")
def r02(spark, sf):
    return rnd(market.tail_stat(returns(spark, sf), ["sid"], "ret", 0.1), "tail_mean", "cutoff")


@query("r03_concentration", ", w AS (SELECT d, sid, amount / sum(amount) OVER (PARTITION BY d) * 0.9 AS w FROM panel), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY w DESC, sid) AS i FROM w) SELECT d, round(sum(w) FILTER (i <= 1), 6) AS top1, round(sum(w) FILTER (i <= 3), 6) AS top3, round(sum(w) FILTER (i <= 5), 6) AS top5, round(1 - sum(w), 6) AS cash FROM k GROUP BY d", "panel")
def r03(spark, sf):
    w = views.panel(spark, sf).select("d", "sid", (C("amount") / F.sum("amount").over(Window.partitionBy("d")) * 0.9).alias("w"))
    return rnd(market.concentration(w, ["d"], "w", "sid"), "top1", "top3", "top5", "cash")


@query("r04_scenarios", _RET + ", b AS (SELECT sid, regr_slope(ret, iret) AS beta FROM r GROUP BY sid), x AS (SELECT idx, r.sid, coalesce(CASE WHEN r.sid % 4 <> 0 THEN ret END, beta * iret) AS loss FROM r JOIN b USING (sid)) SELECT idx, round(sum(loss) / count(*), 6) AS loss FROM x WHERE idx > 0 GROUP BY idx", "panel")
def r04(spark, sf):
    r = returns(spark, sf)
    b = r.groupBy("sid").agg(F.regr_slope("ret", "iret").alias("beta"))
    x = r.join(b, "sid").where("idx > 0").withColumn("loss", F.coalesce(F.when(C("sid") % 4 != 0, C("ret")), C("beta") * C("iret")))
    return x.groupBy("idx").agg(F.round(F.sum("loss") / F.count("*"), 6).alias("loss"))


_LEVELS = """, g AS (SELECT sid AS k, d AS t, 1000 + sum(amount - 10 * volume) OVER (PARTITION BY sid ORDER BY d ROWS UNBOUNDED PRECEDING) AS e FROM bars), a AS (SELECT k, max(t) - 5 AS t FROM g WHERE k % 7 = 0 GROUP BY k), x AS (SELECT g.*, 0 AS era, CAST(g.t > a.t AS INT) AS spell FROM g LEFT JOIN a USING (k))""" + LEVELS_SQL.format(halt=0.1) + """,
    s AS (SELECT k, t, 0 AS o, CASE WHEN loss >= 0.05 THEN true WHEN loss < 0.02 THEN false END AS says FROM c UNION ALL SELECT a.k, a.t, 1, CASE WHEN max(c.halted AND c.spell = 0) THEN true END FROM a JOIN c USING (k) GROUP BY a.k, a.t), r AS (SELECT k, t, o, last_value(says IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS reducing FROM s)"""


@query("r05_drawdown_state", _LEVELS + " SELECT c.k AS account, c.t AS d, CASE WHEN halted THEN 3 WHEN reducing THEN 2 WHEN loss >= 0.01 THEN 1 ELSE 0 END AS level, round(peak, 6) AS peak, round(loss, 6) AS loss FROM c JOIN r ON r.k = c.k AND r.t = c.t AND o = 0", "bars")
def r05(spark, sf):
    """An account for each user: what its events brought so far; every seventh account is resumed on one day."""
    w = Window.partitionBy("account").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    c = views.bars(spark, sf).select(C("sid").alias("account"), "d", (C("amount") - 10 * C("volume")).alias("gain")).select("account", "d", (1000 + F.sum("gain").over(w)).alias("equity"))
    resumed = c.where("account % 7 = 0").groupBy("account").agg(F.max("d").alias("d")).select("account", F.date_sub("d", 5).alias("d"), F.lit("resume").alias("kind"), F.lit(None).cast("double").alias("peak"))
    return rnd(market.drawdown_state(c, "account", "d", "equity", (0.01, 0.05, 0.1), 0.02, resumed), "peak", "loss")


@query("r06_index_summary", ", i AS (SELECT d, avg(close) AS c FROM panel GROUP BY d), k AS (SELECT *, row_number() OVER (ORDER BY d DESC) AS i FROM i) SELECT max(d) AS d, round(arg_max(c, d), 6) AS last, round(max(c) FILTER (i = 1) - max(c) FILTER (i = 2), 6) AS change, round(max(c), 6) AS hi, round(min(c), 6) AS lo FROM k WHERE i <= 20", "panel")
def r06(spark, sf):
    i = views.panel(spark, sf).groupBy("d").agg(F.avg("close").alias("c")).withColumn("i", F.row_number().over(Window.orderBy(F.desc("d")))).where("i <= 20")
    return rnd(i.agg(F.max("d").alias("d"), F.max_by("c", "d").alias("last"), (F.max(F.when(C("i") == 1, C("c"))) - F.max(F.when(C("i") == 2, C("c")))).alias("change"), F.max("c").alias("hi"), F.min("c").alias("lo")), "last", "change", "hi", "lo")


@query("r07_flow_summary", ", f AS (SELECT sector, d, sum(amount) AS a, sum(volume) AS v FROM panel GROUP BY ALL), k AS (SELECT *, dense_rank() OVER (PARTITION BY sector ORDER BY d DESC) AS r FROM f) SELECT sector, round(sum(a) FILTER (r <= 1), 6) AS amount_1, round(sum(a) FILTER (r <= 5), 6) AS amount_5, CAST(sum(v) FILTER (r <= 1) AS BIGINT) AS volume_1, CAST(sum(v) FILTER (r <= 5) AS BIGINT) AS volume_5 FROM k GROUP BY sector", "panel")
def r07(spark, sf):
    return rnd(market.flow_summary(views.panel(spark, sf), "sector", "d", ["amount", "volume"], [1, 5]), "amount_1", "amount_5")


@query("r08_breadth", ", b AS (SELECT idx, close, lag(close) OVER (PARTITION BY sid ORDER BY idx) AS p, close >= max(high) OVER w AS hi, close <= min(low) OVER w AS lo FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT idx, count(*) FILTER (close > p) AS up, count(*) FILTER (close < p) AS down, count(*) FILTER (close = p) AS flat, count(*) FILTER (hi) AS highs, count(*) FILTER (lo) AS lows FROM b GROUP BY idx", "panel")
def r08(spark, sf):
    return market.breadth(views.panel(spark, sf), "sid", "idx", 10)


@query("r09_latest_complete", ", n AS (SELECT d, count(*) AS n FROM bars GROUP BY d) SELECT d, n, coalesce(n >= 0.9 * lag(n) OVER (ORDER BY d), true) AS complete FROM n", "bars")
def r09(spark, sf):
    return market.latest_complete(views.bars(spark, sf), "d", 0.9)


@query("r10_flow_sheet", "SELECT sid, round(sum(amount) FILTER (idx >= 20), 4) AS recent, round(sum(amount) FILTER (idx >= 20) / nullif(sum(amount), 0), 6) AS share FROM panel GROUP BY sid", "panel")
def r10(spark, sf):
    recent = F.sum(F.when(C("idx") >= 20, C("amount")))
    return views.panel(spark, sf).groupBy("sid").agg(F.round(recent, 4).alias("recent"), F.round(recent / F.sum("amount"), 6).alias("share"))


@query("r11_analyst_sheet", ", r AS (SELECT *, lag(value) OVER (PARTITION BY sid ORDER BY d, seq) AS before, row_number() OVER (PARTITION BY sid ORDER BY d DESC, seq DESC) AS i FROM versions) SELECT sid, d, value, round(value - before, 4) AS change FROM r WHERE i = 1", "versions")
def r11(spark, sf):
    from tidemark.operators.versions import latest_per_key

    v = views.versions(spark, sf).withColumn("before", F.lag("value").over(Window.partitionBy("sid").orderBy("d", "seq")))
    return latest_per_key(v, ["sid"], ["d", "seq"]).select("sid", "d", "value", F.round(C("value") - C("before"), 4).alias("change"))


@query("r12_events_sheet", "SELECT CAST(ts AS DATE) AS d, CASE WHEN event_type = 'error' THEN 'problem' WHEN value > 50 THEN 'large' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY ALL")
def r12(spark, sf):
    from tidemark.functions.clean import classify

    rules = [("problem", C("event_type") == "error"), ("large", C("value") > 50)]
    return views.read(spark, sf, "events").groupBy(C("ts").cast("date").alias("d"), classify(rules, "other").alias("class")).agg(F.count("*").alias("n"))


@query("r13_etf_flows", ", x AS (SELECT sid, idx, CAST(volume AS DOUBLE) AS s, close AS n, lag(volume) OVER w AS ps, lag(close) OVER w AS pn FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx)) SELECT sid, idx, round(CASE WHEN ps IS NULL THEN NULL WHEN (s / ps >= 1.9 OR s / ps <= 0.55) AND s / ps * (n / nullif(pn, 0)) BETWEEN 0.8 AND 1.25 THEN 0 ELSE (s - ps) * n END, 6) AS flow, ps IS NULL AS opened FROM x", "panel")
def r13(spark, sf):
    p = views.panel(spark, sf).withColumn("volume", C("volume").cast("double"))
    return rnd(market.etf_flows(p, "sid", "idx", "volume", "close"), "flow")


@query("r14_temperature", ", b AS (SELECT idx, count(*) FILTER (close > open) / count(*)::DOUBLE AS up FROM panel GROUP BY idx), l AS (SELECT idx, up AS c, list(up) OVER (ORDER BY idx ROWS 9 PRECEDING) AS l FROM b) SELECT idx, CASE WHEN len(l) >= 4 THEN round((len(list_filter(l, lambda x: x < c)) + (len(list_filter(l, lambda x: x = c)) - 1) * 0.5) / greatest(len(l) - 1, 1), 6) END AS temperature FROM l", "panel")
def r14(spark, sf):
    from tidemark.functions.series import trailing_pct

    b = views.panel(spark, sf).groupBy("idx").agg((F.count_if(C("close") > C("open")) / F.count("*")).alias("up"), F.lit(1).alias("k"))
    return b.select("idx", F.round(trailing_pct(["k"], "idx", C("up"), 10, 4), 6).alias("temperature"))


_STRENGTH = """, x AS (SELECT sid, idx, close - lag(close) OVER w AS x FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx)), l AS (SELECT idx, list(greatest(x, 0)) FILTER (x IS NOT NULL) OVER w AS g, list(greatest(-x, 0)) FILTER (x IS NOT NULL) OVER w AS f FROM x WINDOW w AS (PARTITION BY sid ORDER BY idx)),
    s AS (SELECT idx, list_reduce([list_avg(g[1:5])] || g[6:], lambda a, b : a + (b - a) / 5) AS up, list_reduce([list_avg(f[1:5])] || f[6:], lambda a, b : a + (b - a) / 5) AS down FROM l WHERE len(g) >= 5)"""


@query("r14_market_temperature", _STRENGTH + """, pn AS (SELECT idx, avg(CAST(CASE WHEN down = 0 THEN 100 ELSE up / (up + down) * 100 END < 30 AS DOUBLE)) AS panic FROM s GROUP BY idx), m AS (SELECT idx, close, CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END AS m FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx ROWS 4 PRECEDING)), br AS (SELECT idx, avg(CAST(close > m AS DOUBLE)) AS breadth FROM m WHERE m IS NOT NULL GROUP BY idx),
    ix AS (SELECT idx, sum(amount) / sum(volume) AS c FROM panel GROUP BY idx), ds AS (SELECT idx, CASE WHEN count(*) OVER w = 5 THEN c / avg(c) OVER w - 1 END AS dist FROM ix WINDOW w AS (ORDER BY idx ROWS 4 PRECEDING)), pt AS (SELECT ix.idx, round(breadth, 9) AS a, round(-panic, 9) AS b, round(dist, 9) AS c FROM ix LEFT JOIN br USING (idx) LEFT JOIN pn USING (idx) LEFT JOIN ds USING (idx)),
    ls AS (SELECT *, list(a) FILTER (a IS NOT NULL) OVER w AS la, list(b) FILTER (b IS NOT NULL) OVER w AS lb, list(c) FILTER (c IS NOT NULL) OVER w AS lc FROM pt WINDOW w AS (ORDER BY idx ROWS 11 PRECEDING))
    SELECT idx, round((""" + " + ".join(f"CASE WHEN {x} IS NOT NULL AND len(l{x}) >= 4 THEN (len(list_filter(l{x}, lambda v: v < {x})) + 0.5 * len(list_filter(l{x}, lambda v: v = {x}))) / len(l{x}) END" for x in "abc") + """) / 3 * 100, 6) AS temperature FROM ls""", "panel")
def r14_full(spark, sf):
    """Breadth over a mean, panic turned over and the index's distance from its mean."""
    p = views.panel(spark, sf)
    rsi = technical.recursive_indicators(p, "sid", "idx", 5, 4, 8, 3).select("idx", "rsi")
    panic = market.panic_fraction(rsi, "idx", "rsi")
    w = Window.partitionBy("sid").orderBy("idx").rowsBetween(-4, 0)
    m = p.select("idx", "close", F.when(F.count("*").over(w) == 5, F.avg("close").over(w)).alias("m")).where("m IS NOT NULL")
    breadth = m.groupBy("idx").agg(F.avg((C("close") > C("m")).cast("double")).alias("breadth"))
    v = Window.orderBy("idx").rowsBetween(-4, 0)
    index = p.groupBy("idx").agg((F.sum("amount") / F.sum("volume")).alias("c"))
    index = index.select("idx", F.when(F.count("*").over(v) == 5, C("c") / F.avg("c").over(v) - 1).alias("dist"))
    parts = index.join(breadth, "idx", "left").join(panic, "idx", "left").select("idx", F.round("breadth", 9).alias("a"), F.round(-C("panic"), 9).alias("b"), F.round("dist", 9).alias("c"))
    return rnd(market.temperature(parts, "idx", ["a", "b", "c"], 12, 4), "temperature")


@query("r15_panic_fraction", _STRENGTH + " SELECT idx, round(avg(CASE WHEN down > 0 AND 100 * up / (up + down) < 30 THEN 1.0 ELSE 0.0 END), 6) AS panic FROM s GROUP BY idx", "panel")
def r15(spark, sf):
    from tidemark.operators.technical import recursive_indicators

    return rnd(market.panic_fraction(recursive_indicators(views.panel(spark, sf), "sid", "idx", 5, 4, 8, 3), "idx", "rsi"), "panic")


@query("r16_sector_members", "SELECT sid, l1, l2, s_acctbal, row_number() OVER (PARTITION BY l2 ORDER BY s_acctbal DESC, sid) AS place FROM sectors", "sectors")
def r16(spark, sf):
    return views.sectors(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("l2").orderBy(F.desc("s_acctbal"), "sid")))


@query("r17_side_panel", "SELECT p.sid, p.d, p.close, round(m.a, 4) AS market_amount FROM panel p LEFT JOIN (SELECT d, sector, sum(amount) AS a FROM panel GROUP BY ALL) m USING (d, sector)", "panel")
def r17(spark, sf):
    p = views.panel(spark, sf)
    m = p.groupBy("d", "sector").agg(F.round(F.sum("amount"), 4).alias("market_amount"))
    return p.join(m, ["d", "sector"], "left").select("sid", "d", "close", "market_amount")


@query("r18_universe_snapshot", ", m AS (SELECT sid, idx, close, avg(close) OVER (PARTITION BY sid ORDER BY idx ROWS 9 PRECEDING) AS ma, row_number() OVER (PARTITION BY sid ORDER BY idx DESC) AS i FROM panel) SELECT sid, close, round(ma, 6) AS ma, close > ma AS bull FROM m WHERE i = 1", "panel")
def r18(spark, sf):
    w = Window.partitionBy("sid")
    m = views.panel(spark, sf).withColumn("ma", F.avg("close").over(w.orderBy("idx").rowsBetween(-9, 0))).withColumn("i", F.row_number().over(w.orderBy(F.desc("idx")))).where("i = 1")
    return m.select("sid", "close", F.round("ma", 6).alias("ma"), (C("close") > C("ma")).alias("bull"))


@query("r19_decile_odds", ", f AS (SELECT sid, idx, round(amount, 6) AS amount, lead(close, 3) OVER (PARTITION BY sid ORDER BY idx) / nullif(close, 0) - 1 AS fwd FROM panel), g AS (SELECT *, ntile(10) OVER (PARTITION BY idx ORDER BY amount, sid) AS decile FROM f WHERE idx < 24 AND fwd IS NOT NULL) SELECT decile, count(*) AS n, round(avg(CAST(fwd > 0 AS INT)), 6) AS odds, round(avg(fwd), 5) AS mean, round((SELECT avg(CAST(fwd > 0 AS INT)) FROM g), 6) AS base FROM g GROUP BY decile", "panel")
def r19(spark, sf):
    p = views.panel(spark, sf).withColumn("amount", F.round("amount", 6))  # a sum's last bits depend on its order
    d = market.decile_odds(p, "sid", "idx", "amount", "close", 3, C("idx") >= 24)
    return d.select("decile", "n", F.round("odds", 6).alias("odds"), F.round("mean", 5).alias("mean"), F.round("base", 6).alias("base"))
