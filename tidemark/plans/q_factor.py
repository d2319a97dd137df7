"""Factor graph nodes over the bars panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import factor
from tidemark.operators.factor import Node

from . import views
from .registry import query

C = F.col
W = "WINDOW w AS (PARTITION BY sid ORDER BY idx)"


def panel(spark, sf):
    p = views.panel(spark, sf)
    masked = F.pmod(C("sid") + C("idx"), F.lit(11)) == 0
    return p.withColumn("member", C("sector") != 4).withColumn("close_masked", masked).withColumn("x", F.when(F.pmod(C("sid") + C("idx"), F.lit(6)) != 0, C("close")))


FIELD = {"c": Node("field", (), {"column": "close"}), "o": Node("field", (), {"column": "open"}), "x": Node("field", (), {"column": "x"}), "m": Node("field", (), {"column": "close", "mask": "close_masked"})}


def node(name: str, graph: dict, expr: str, extra: str = "", out: str = "y"):
    """A query of one graph against a SQL expression over p, the panel with member, x and close_masked."""
    base = ", p AS (SELECT *, sector <> 4 AS member, (sid + idx) % 11 = 0 AS close_masked, CASE WHEN (sid + idx) % 6 <> 0 THEN close END AS x FROM panel)"
    sql = f"{base}{extra} SELECT sid, d, {expr} AS value FROM {'e' if extra else 'p'} {W}"

    def run(spark, sf):
        d = factor.evaluate_graph(panel(spark, sf), FIELD | graph, out).select("sid", "d", "value")
        return d.withColumn("value", F.round("value", 6) if dict(d.dtypes)["value"] == "double" else C("value").cast("int"))

    query(name, sql, "panel")(run)


def full(x: str, n: int, lag: int = 0) -> str:
    return f"CASE WHEN count(x) OVER (w ROWS BETWEEN {lag + n - 1} PRECEDING AND {lag} PRECEDING) = {n} THEN round({x}, 6) END"


def frame(f: str, n: int, lag: int = 0) -> str:
    return f"{f}(x) OVER (w ROWS BETWEEN {lag + n - 1} PRECEDING AND {lag} PRECEDING)"


node("g01_field", {}, "round(x, 6)", out="x")
node("g01_field_masked", {}, "CASE WHEN NOT close_masked THEN round(close, 6) END", out="m")
node("g02_const", {"y": Node("const", (), {"value": 2.5})}, "CAST(2.5 AS DOUBLE)")
node("g03_negate", {"y": Node("negate", ("x",))}, "round(-x, 6)")
node("g04_lag", {"y": Node("lag", ("x",), {"k": 3})}, "round(lag(x, 3) OVER w, 6)")
node("g05_add", {"y": Node("add", ("x", "o"))}, "round(x + open, 6)")
node("g05_divide", {"z": Node("subtract", ("o", "o")), "y": Node("divide", ("x", "z"))}, "CAST(NULL AS DOUBLE)")
node("g05_multiply", {"y": Node("multiply", ("x", "o"))}, "round(x * open, 6)")
node("g06_mean", {"y": Node("mean", ("x",), {"window": 4, "lag": 1})}, full(frame("avg", 4, 1), 4, 1))
node("g07_std", {"y": Node("std", ("x",), {"window": 4})}, full(frame("stddev_pop", 4), 4))
node("g08_momentum", {"y": Node("momentum", ("x",), {"window": 3, "lag": 1})}, full("lag(x, 1) OVER w / nullif(lag(x, 3) OVER w, 0) - 1", 3, 1))
node("g09_delta", {"y": Node("delta", ("x",), {"window": 4})}, full("x - lag(x, 3) OVER w", 4))
node("g10_min", {"y": Node("min", ("x",), {"window": 3})}, full(frame("min", 3), 3))
node("g10_max", {"y": Node("max", ("x",), {"window": 3})}, full(frame("max", 3), 3))
PEERS = "PARTITION BY d, member"
RANK = "CASE WHEN x IS NOT NULL THEN round((rank() OVER ({0}, x IS NULL ORDER BY x) + (count(*) OVER ({0}, x) - 1) / 2.0 - 1) / greatest(count(*) OVER ({0}, x IS NULL) - 1, 1), 6) END"
node("g11_rank", {"y": Node("rank", ("x",))}, RANK.format(PEERS))
node("g11_zscore", {"y": Node("zscore", ("x",))}, f"CASE WHEN x IS NOT NULL THEN CASE WHEN stddev_pop(x) OVER ({PEERS}) = 0 THEN 0.0 ELSE round((x - avg(x) OVER ({PEERS})) / stddev_pop(x) OVER ({PEERS}), 6) END END")
node("g11_winsorize", {"y": Node("winsorize", ("x",), {"lo": 0.2, "hi": 0.8})}, f"CASE WHEN x IS NOT NULL THEN round(greatest(quantile_cont(x, 0.2) OVER ({PEERS}), least(quantile_cont(x, 0.8) OVER ({PEERS}), x)), 6) END")
node("g11_demean", {"y": Node("demean", ("x",))}, f"round(x - avg(x) OVER ({PEERS}), 6)")
node("g12_neutralize", {"y": Node("neutralize", ("x",), {"group": "sector"})}, "round(x - avg(x) OVER (PARTITION BY d, member, sector), 6)")
node("g12_group_rank", {"y": Node("group_rank", ("x",), {"group": "sector"})}, RANK.format("PARTITION BY d, member, sector"))
node("g13_compare", {"y": Node("gt", ("x", "o"))}, "CAST(x > open AS INT)")
node("g14_cond", {"k": Node("gt", ("x", "o")), "y": Node("cond", ("k", "x", "o"))}, "round(CASE WHEN x > open THEN x WHEN NOT x > open THEN open END, 6)")
node("g15_fill", {"g": Node("mean", ("m",), {"window": 3}), "y": Node("fill", ("g",), {"value": 7})},
     "CASE WHEN NOT coalesce(max(CAST(close_masked AS INT)) OVER (w ROWS 2 PRECEDING) = 1, false) THEN round(coalesce(CASE WHEN count(u) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(u) OVER (w ROWS 2 PRECEDING) END, 7), 6) END",
     ", e AS (SELECT *, CASE WHEN NOT close_masked THEN close END AS u FROM p)")
node("g16_missing_median", {"y": Node("demean", ("x",), {"missing": "median"})}, "round(v - avg(v) OVER (PARTITION BY d, member), 6)", ", e AS (SELECT *, coalesce(x, median(x) OVER (PARTITION BY d, member)) AS v FROM p)")
node("g16_missing_zero", {"y": Node("demean", ("x",), {"missing": "zero"})}, "round(v - avg(v) OVER (PARTITION BY d, member), 6)", ", e AS (SELECT *, CASE WHEN x IS NULL AND count(x) OVER (PARTITION BY d, member) > 0 THEN 0 ELSE x END AS v FROM p)")
GRAPH = {"a": Node("mean", ("x",), {"window": 3}), "b": Node("subtract", ("c", "a")), "r": Node("rank", ("b",)), "n": Node("neutralize", ("r",), {"group": "sector"}), "y": Node("add", ("r", "n"))}
node("g20_evaluate_graph", GRAPH, "round(r + r - avg(r) OVER (PARTITION BY d, member, sector), 6)",
     ", b AS (SELECT *, close - CASE WHEN count(x) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(x) OVER (w ROWS 2 PRECEDING) END AS b FROM p " + W + "), e AS (SELECT *, CASE WHEN b IS NOT NULL THEN (rank() OVER (PARTITION BY d, member, b IS NULL ORDER BY b) + (count(*) OVER (PARTITION BY d, member, b) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY d, member, b IS NULL) - 1, 1) END AS r FROM b)")


@query("g17_mask_span", ", p AS (SELECT *, (sid + idx) % 11 = 0 AS close_masked FROM panel) SELECT sid, d, coalesce(max(CAST(close_masked AS INT)) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 1, false) AS masked FROM p", "panel")
def g17(spark, sf):
    graph = FIELD | {"a": Node("mean", ("m",), {"window": 4}), "y": Node("momentum", ("a",), {"window": 2, "lag": 1})}
    return panel(spark, sf).select("sid", "d", factor.mask_column(graph, "y", factor.Panel()).alias("masked"))


@query("g18_not_finite", "SELECT d, sid, 'z' AS node FROM panel WHERE sid % 7 = 0", "panel")
def g18(spark, sf):
    z = F.when(C("sid") % 7 == 0, F.lit(float("inf"))).otherwise(C("close"))
    return factor.not_finite(panel(spark, sf).withColumn("z", z), ["z", "close"])


@query("g21_trace_graph", ", p AS (SELECT *, CASE WHEN (sid + idx) % 6 <> 0 THEN close END AS x FROM panel), a AS (SELECT *, CASE WHEN count(x) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(x) OVER (w ROWS 2 PRECEDING) END AS a FROM p " + W + ") SELECT d, sid, node, round(value, 6) AS value FROM (SELECT d, sid, close AS c, x, a, close - a AS b FROM a WHERE sid < 5) UNPIVOT INCLUDE NULLS (value FOR node IN (c, x, a, b))", "panel")
def g21(spark, sf):
    graph = FIELD | {"a": Node("mean", ("x",), {"window": 3}), "b": Node("subtract", ("c", "a"))}
    t = factor.trace_graph(panel(spark, sf), graph, "b", C("sid") < 5)
    return t.select("d", "sid", "node", F.round("value", 6).alias("value"))


@query("g22_factor_library", ", m AS (SELECT sid, d, avg(amount) OVER (w ROWS 19 PRECEDING) AS v, count(amount) OVER (w ROWS 19 PRECEDING) AS n FROM panel " + W + ") SELECT sid, d, CASE WHEN n = 20 THEN round(v, 6) END AS value FROM m", "panel")
def g22(spark, sf):
    graph, out = factor.library("foreign_net_20")
    p = panel(spark, sf).withColumn("foreign_net", C("amount"))
    return factor.evaluate_graph(p, graph, out).select("sid", "d", F.round("value", 6).alias("value"))
