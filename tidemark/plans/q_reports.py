"""Scenarios, verdicts on grids, revisions by horizon, changes of row counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import reports

from . import views
from .q_market import _RET, returns
from .registry import query

C = F.col


def rnd(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else C(c) for c in df.columns])


# Windows of the scenarios.
WINDOWS = [("early", "2024-01-03", "2024-01-10"), ("late", "2024-01-15", "2024-01-25"), ("before", "2023-06-01", "2023-07-01")]
_VALUES = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WINDOWS)


@query("r04_all_scenarios", _RET + f""", b AS (SELECT sid, CASE WHEN count(ret) >= 5 THEN regr_slope(ret, iret) END AS beta FROM r WHERE idx > 0 GROUP BY sid), w AS (SELECT sid % 10 AS book, sid, sum(amount) / sum(sum(amount)) OVER (PARTITION BY sid % 10) AS weight FROM panel GROUP BY sid), win(scenario, a, z) AS (VALUES {_VALUES}),
    h AS (SELECT book, w.sid, weight, scenario, iz.ix / ia.ix - 1 AS market, coalesce(pz.close / nullif(pa.close, 0) - 1, beta * (iz.ix / ia.ix - 1)) AS ret, pz.close / nullif(pa.close, 0) IS NULL AS p FROM w CROSS JOIN win LEFT JOIN b USING (sid) LEFT JOIN panel pa ON pa.sid = w.sid AND pa.d = a LEFT JOIN panel pz ON pz.sid = w.sid AND pz.d = z LEFT JOIN i ia ON ia.d = a LEFT JOIN i iz ON iz.d = z),
    l AS (SELECT book, sid, weight, scenario, market, ret, p AND ret IS NOT NULL AS proxy FROM h UNION ALL SELECT book, sid, weight, 'circuit', -0.2, CASE WHEN beta IS NOT NULL THEN greatest(-0.3, beta * -0.2) END, false FROM w LEFT JOIN b USING (sid) UNION ALL SELECT book, arg_max(sid, (weight, sid)), max(weight), 'gap', NULL, -0.3, false FROM w GROUP BY book)
    SELECT book, scenario, round(sum(coalesce(weight * ret, 0)), 6) AS portfolio, round(max(market), 6) AS "index", count(ret) AS lines, count(*) FILTER (proxy) AS proxies, count(*) FILTER (ret IS NULL) AS missing FROM l GROUP BY ALL""", "panel")
def r04_all(spark, sf):
    p = views.panel(spark, sf)
    betas = returns(spark, sf).where("idx > 0").groupBy("sid").agg(F.when(F.count("ret") >= 5, F.regr_slope("ret", "iret")).alias("beta"))
    w = p.groupBy("sid").agg(F.sum("amount").alias("a")).withColumn("book", C("sid") % 10)
    w = w.select("book", "sid", (C("a") / F.sum("a").over(Window.partitionBy("book"))).alias("weight"))
    s = reports.scenarios(w, p.select("sid", "d", "close"), p.groupBy("d").agg(F.avg("close").alias("close")), betas, WINDOWS, "book", "sid")
    return rnd(s.withColumn("missing", F.size("missing")), "portfolio", "index")


AXIS_VALUES = {"a": [1.0, 1.1, 1.5, 2.0, 3.0, 5.0, 8.0], "b": [-2.0, -1.0, 0.0, 1.0, 1.25, 2.0, 2.1, 2.2, 4.0, 5.0, 6.0, 9.0]}
_TRIALS = """t AS (SELECT l_suppkey % 8 AS e, l_linenumber - 1 AS a, month(l_shipdate) - 1 AS b, year(l_shipdate) % 3 AS w, CASE WHEN sum(l_quantity) % 23 < 2 THEN 'failed' WHEN sum(l_quantity) % 29 = 5 THEN 'running' ELSE 'completed' END AS status, sum(l_quantity) % 23 < 1 AS bankrupt, CASE WHEN sum(l_quantity) % 31 <> 7 THEN avg(l_discount) - 0.045 END AS score FROM lineitem GROUP BY ALL),
    c AS (SELECT e, a, b, CASE WHEN bool_or(status = 'failed' AND bankrupt) THEN 'bankrupt' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed' AND score IS NOT NULL) THEN 'scored' ELSE 'open' END AS outcome, avg(score) AS s FROM t GROUP BY e, a, b)"""
_MOVES = ", ".join(str(m) for m in reports.moves(AXIS_VALUES))
_PLATEAU = "WITH " + _TRIALS + f""", f AS (SELECT e, a, b, CASE WHEN outcome = 'scored' THEN s ELSE coalesce(least(min(CASE WHEN outcome = 'scored' THEN s END) OVER (PARTITION BY e), 0), 0) END AS v, outcome FROM c), g AS (SELECT * FROM f WHERE outcome IN ('scored', 'bankrupt')),
    n AS (SELECT x.e, x.a, x.b, any_value(x.v) AS score, avg(y.v) AS nm FROM g x LEFT JOIN g y ON y.e = x.e AND abs(x.a - y.a) <= 1 AND abs(x.b - y.b) <= 1 AND (x.a <> y.a OR x.b <> y.b) WHERE x.outcome = 'scored' GROUP BY ALL),
    k AS (SELECT *, coalesce(nm, score) AS rank, score > 0 AND coalesce(nm, score) > 0 AND (nm IS NOT NULL OR NOT bool_or(nm IS NOT NULL) OVER (PARTITION BY e)) AS able, max(score) OVER (PARTITION BY e) AS top FROM n), v AS (SELECT *, able AND row_number() OVER (PARTITION BY e, able ORDER BY rank DESC, a, b) = 1 AS best FROM k),
    m(axis, i, j, o) AS (VALUES {_MOVES}), d AS (SELECT v.e, v.a, v.b, (v.score - g.v) / v.score AS dr, m.axis || ':' || m.j AS moved, CASE WHEN axis = 'b' THEN 2 ELSE 0 END + o AS o FROM v JOIN m ON CASE WHEN axis = 'a' THEN v.a ELSE v.b END = m.i JOIN g ON g.e = v.e AND g.a = CASE WHEN axis = 'a' THEN m.j ELSE v.a END AND g.b = CASE WHEN axis = 'b' THEN m.j ELSE v.b END WHERE v.score > 0),
    z AS (SELECT e, a, b, arg_max(dr, (dr, -o)) AS sensitivity FROM d GROUP BY ALL)
    SELECT v.e, v.a, v.b, round(score, 6) AS score, round(nm, 6) AS neighbor_mean, CASE WHEN best THEN 'recommended' WHEN score = top AND score > 0 AND rank < 0.5 * score THEN 'peak' ELSE 'scored' END AS verdict, round(sensitivity, 6) AS sensitivity FROM v LEFT JOIN z USING (e, a, b) UNION ALL SELECT e, a, b, NULL, NULL, CASE WHEN outcome = 'open' THEN 'unscored' ELSE 'failed' END, NULL FROM c WHERE outcome <> 'scored'"""


@query("e16_plateau_verdicts", _PLATEAU)
def e16_verdicts(spark, sf):
    li = views.read(spark, sf, "lineitem")
    t = li.groupBy((C("l_suppkey") % 8).alias("e"), (C("l_linenumber") - 1).alias("a"), (F.month("l_shipdate") - 1).alias("b"), (F.year("l_shipdate") % 3).alias("w")).agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("x"))
    t = t.withColumn("status", F.when(C("q") % 23 < 2, "failed").when(C("q") % 29 == 5, "running").otherwise("completed")).withColumn("bankrupt", C("q") % 23 < 1).withColumn("score", F.when(C("q") % 31 != 7, C("x") - 0.045))
    v = reports.plateau_verdicts(reports.outcomes(t, ["e"], ["a", "b"]), ["e"], AXIS_VALUES)
    return rnd(v.drop("moved"), "score", "neighbor_mean", "sensitivity")


_EST = """e AS (SELECT o_custkey AS sid, strftime(o_orderdate, '%Y/%m') AS period, unnest(['now', '1m', '3m']) AS horizon, unnest([sum(o_totalprice) - 200000, CASE WHEN count(*) % 3 <> 0 THEN sum(o_totalprice) - 260000 END, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 200000 - sum(o_totalprice) END]) AS v, count(*) + o_custkey % 2 AS n FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y/%m')),
    p AS (SELECT sid, min(period) FILTER (period >= '1996/05') AS period FROM e GROUP BY sid), j AS (SELECT p.sid, p.period, max(v) FILTER (horizon = 'now') AS now, max(n) FILTER (horizon = 'now') AS n, max(v) FILTER (horizon = '1m') AS m1, max(v) FILTER (horizon = '3m') AS m3 FROM p LEFT JOIN e ON e.sid = p.sid AND e.period = p.period GROUP BY ALL),
    r AS (SELECT *, CASE WHEN period IS NULL THEN 'no_period' WHEN coalesce(n, 0) < 2 THEN 'few_analysts' WHEN now IS NULL OR m1 IS NULL THEN 'no_source' WHEN m1 = 0 THEN 'zero_base' END AS r1, CASE WHEN period IS NULL THEN 'no_period' WHEN coalesce(n, 0) < 2 THEN 'few_analysts' WHEN now IS NULL OR m3 IS NULL THEN 'no_source' WHEN m3 = 0 THEN 'zero_base' END AS r3 FROM j)"""
_FLAG = "CASE WHEN {m} < 0 AND now > 0 THEN 'turned_positive' WHEN {m} > 0 AND now < 0 THEN 'turned_negative' WHEN {m} < 0 AND now < 0 THEN CASE WHEN abs(now) > abs({m}) THEN 'loss_grew' ELSE 'loss_shrank' END END"


@query("m05_revisions_by_horizon", "WITH " + _EST + " SELECT sid, period, " + ", ".join(f"round(CASE WHEN r{k} IS NULL THEN (now - m{k}) / abs(m{k}) END, 6) AS revision_{k}m, CASE WHEN r{k} IS NULL THEN {_FLAG.format(m=f'm{k}')} END AS flag_{k}m, r{k} AS reason_{k}m" for k in (1, 3)) + " FROM r")
def m05_horizons(spark, sf):
    o = views.read(spark, sf, "orders").groupBy(C("o_custkey").alias("sid"), F.date_format("o_orderdate", "yyyy/MM").alias("period")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("k"))
    row = lambda h, v: F.struct(F.lit(h).alias("horizon"), v.cast("double").alias("v"))
    rows = F.array(row("now", C("v") - 200000), row("1m", F.when(C("k") % 3 != 0, C("v") - 260000)), row("3m", F.when(C("sid") % 5 == 0, 0.0).otherwise(200000 - C("v"))))
    e = o.select("sid", "period", (C("k") + C("sid") % 2).alias("n"), F.explode(rows).alias("r")).select("sid", "period", "n", "r.*").withColumn("month", F.lit("1996/05"))
    return rnd(reports.revisions_by_horizon(e, ["sid"], "month", "period", "horizon", "v", "n", 2), "revision_1m", "revision_3m")


_COUNTS = "SELECT p_brand AS t, count(*) AS n_in, count(*) FILTER (p_size <> 7 AND p_size <= {m}) AS n_out, count(*) FILTER (p_size = 7 AND p_size <= {m}) AS n_dedup, count(*) FILTER (p_size > {m}) {x} AS n_reject FROM part WHERE {w} GROUP BY 1"


@query("q02_row_count_changes", "WITH a AS (" + _COUNTS.format(m=45, x="+ CASE WHEN p_brand = 'Brand#13' THEN 1 ELSE 0 END", w="p_brand <> 'Brand#12'") + "), b AS (" + _COUNTS.format(m=40, x="", w="p_brand <> 'Brand#11' AND p_partkey % 3 <> 0") + ") SELECT coalesce(a.t, b.t) AS t, a.n_in - b.n_in AS d_in, a.n_out - b.n_out AS d_out, a.n_in - b.n_in - (a.n_dedup - b.n_dedup) - (a.n_reject - b.n_reject) AS expected, CASE WHEN b.t IS NULL THEN 'skip' WHEN a.t IS NULL THEN 'missing' WHEN a.n_out - b.n_out = a.n_in - b.n_in - (a.n_dedup - b.n_dedup) - (a.n_reject - b.n_reject) THEN 'pass' ELSE 'fail' END AS verdict FROM a FULL JOIN b ON a.t = b.t")
def q02_changes(spark, sf):
    p = views.read(spark, sf, "part").withColumnRenamed("p_brand", "t")

    def counts(d, most):
        return d.groupBy("t").agg(F.count("*").alias("n_in"), F.count_if((C("p_size") != 7) & (C("p_size") <= most)).alias("n_out"), F.count_if((C("p_size") == 7) & (C("p_size") <= most)).alias("n_dedup"), F.count_if(C("p_size") > most).alias("n_reject"))

    now = counts(p.where("t <> 'Brand#12'"), 45).withColumn("n_reject", C("n_reject") + (C("t") == "Brand#13").cast("int"))
    return reports.row_count_changes(now, counts(p.where("t <> 'Brand#11' AND p_partkey % 3 <> 0"), 40), "t")
