"""Grids of short sales, balances and flows over the events' sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cells

from . import views
from .registry import query

C = F.col
FIRST = 2
_E = """, ev AS (SELECT e.user_id AS sid, c.idx, event_id, event_type AS t, round(value, 4) AS v FROM events e JOIN calendar c ON c.d = CAST(e.ts AS DATE)), sp AS (SELECT sid, greatest(min(idx), 2) AS a, max(idx) - 1 AS z FROM ev GROUP BY sid), grid AS (SELECT sid, unnest(range(a, z + 1)) AS idx FROM sp WHERE a <= z)"""
_COVER = ", {n} AS (SELECT sid, idx, max(p) AS p FROM (SELECT sid, unnest(range(idx, idx + 1 + event_id % 4)) AS idx, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS p FROM ev WHERE t = '{t}' AND event_id % 3 < 2) GROUP BY ALL)"


def ledger(spark, sf):
    """Events with their session, and the grid: from a user's first session, the calendar's third at least, to the last but one."""
    b = views.bars(spark, sf)
    e = views.read(spark, sf, "events").withColumn("d", C("ts").cast("date")).join(views.calendar(b).select("d", "idx"), "d")
    e = e.select(C("user_id").alias("sid"), C("idx").cast("long").alias("idx"), "event_id", C("event_type").alias("t"), F.round("value", 4).alias("v"))
    span = e.groupBy("sid").agg(F.greatest(F.min("idx"), F.lit(FIRST)).alias("a"), (F.max("idx") - 1).alias("z")).where("a <= z")
    return e, span.select("sid", F.explode(F.sequence("a", "z")).alias("idx"))


def source(e, name, kind, asked, column="v", full="unit_ok", empty="unit_empty"):
    rows = e.where(C("t") == kind).select("sid", "idx", "event_id", C("v").alias(column))
    ask = e.where((C("t") == asked) & (C("event_id") % 3 < 2)).select("sid", F.when(C("event_id") % 3 == 0, "empty").otherwise("full").alias("status"), C("idx").alias("lo"), (C("idx") + C("event_id") % 4).alias("hi"))
    return cells.Source(name, rows, [column], ["event_id"], ask, full, empty)


_FILL = "CASE WHEN {r} IS NOT NULL THEN 'measured' WHEN {p} = 2 THEN 'src_omitted' WHEN {p} = 1 THEN 'empty_response' ELSE 'not_collected' END AS kind_{n}, CASE WHEN {p} = 2 THEN '{f}' WHEN {p} = 1 THEN '{e}' ELSE 'none' END AS evidence_{n}"
_FOUR = [("short_a", "purchase", "click", "shard_done", "shard_empty"), ("short_b", "view", "error", "unit_ok", "unit_empty"), ("loan", "signup", "purchase", "unit_ok", "unit_empty"), ("lending", "error", "view", "shard_done", "shard_empty")]


@query("d13_short_grid", _E + "".join(_COVER.format(n=f"c_{n}", t=a) + f", r_{n} AS (SELECT sid, idx, arg_min(v, event_id) AS v FROM ev WHERE t = '{t}' GROUP BY ALL)" for n, t, a, *_ in _FOUR) + ", al AS (SELECT sid, idx, 1 AS g FROM grid UNION ALL SELECT sid, idx, 0 FROM (" + " UNION ".join(f"SELECT sid, idx FROM r_{n}" for n, *_ in _FOUR) + ") x WHERE NOT EXISTS (SELECT 1 FROM grid WHERE grid.sid = x.sid AND grid.idx = x.idx)) SELECT al.sid, al.idx, " + ", ".join(f"r_{n}.v AS {n}, " + _FILL.format(r=f"r_{n}.sid", p=f"c_{n}.p", n=n, f=f, e=e) for n, _, _, f, e in _FOUR) + ", CASE WHEN g = 0 THEN CASE WHEN al.idx < 2 THEN 'pre_calendar' ELSE 'off_grid' END END AS reject_reason FROM al " + " ".join(f"LEFT JOIN r_{n} ON r_{n}.sid = al.sid AND r_{n}.idx = al.idx LEFT JOIN c_{n} ON c_{n}.sid = al.sid AND c_{n}.idx = al.idx" for n, *_ in _FOUR), "calendar")
def d13_grid(spark, sf):
    e, grid = ledger(spark, sf)
    g = cells.filled_grid(grid, "sid", "idx", FIRST, [source(e, n, t, a, n, f, m) for n, t, a, f, m in _FOUR])
    return g.select("sid", "idx", *[n for n, *_ in _FOUR], *[C(f"fill_{n}")[k].alias(f"{k}_{n}") for n, *_ in _FOUR for k in ("kind", "evidence")], "reject_reason")


_BAL = _E + _COVER.format(n="cv", t="click") + """, vr AS (SELECT *, row_number() OVER (PARTITION BY sid, idx ORDER BY event_id) AS n FROM ev WHERE t = 'purchase'), sh AS (SELECT sid, idx, 20.0 + (sid + idx) % 90 AS shares FROM ev GROUP BY ALL),
    vj AS (SELECT vr.*, grid.sid IS NOT NULL AS on_, n = 1 AND grid.sid IS NOT NULL AND coalesce(v > shares, false) AS over FROM vr LEFT JOIN sh USING (sid, idx) LEFT JOIN grid ON grid.sid = vr.sid AND grid.idx = vr.idx),
    bl AS (SELECT g.sid, g.idx, CASE WHEN NOT coalesce(over, false) THEN v END AS v, CASE WHEN coalesce(over, false) THEN 'empty_response' WHEN vj.sid IS NOT NULL THEN 'measured' WHEN p = 2 THEN 'src_omitted' WHEN p = 1 THEN 'empty_response' ELSE 'not_collected' END AS kind, CASE WHEN p = 2 THEN 'unit_ok' WHEN p = 1 THEN 'unit_empty' ELSE 'none' END AS evidence, NULL AS reject_reason FROM grid g LEFT JOIN vj ON vj.sid = g.sid AND vj.idx = g.idx AND n = 1 LEFT JOIN cv ON cv.sid = g.sid AND cv.idx = g.idx
        UNION ALL SELECT vj.sid, vj.idx, v, 'measured', CASE WHEN p = 2 THEN 'unit_ok' WHEN p = 1 THEN 'unit_empty' ELSE 'none' END, CASE WHEN n > 1 THEN 'version_folded' WHEN over THEN 'balance_over_shares' WHEN vj.idx < 2 THEN 'pre_calendar' ELSE 'off_grid' END FROM vj LEFT JOIN cv ON cv.sid = vj.sid AND cv.idx = vj.idx WHERE n > 1 OR over OR NOT on_)"""


def balances(spark, sf):
    e, grid = ledger(spark, sf)
    shares = e.select("sid", "idx").distinct().withColumn("shares", (20 + (C("sid") + C("idx")) % 90).cast("double"))
    return e, cells.balance_grid(grid, source(e, "credit", "purchase", "click"), shares, "sid", "idx", FIRST, ["v"])


@query("d14_balance_grid", _BAL + " SELECT sid, idx, v, kind, evidence, reject_reason FROM bl", "calendar")
def d14_grid(spark, sf):
    return balances(spark, sf)[1].select("sid", "idx", "v", "fill.kind", "fill.evidence", "reject_reason")


@query("d14_masked_balances", _BAL + ", bo AS (SELECT DISTINCT sid, unnest(range(idx, idx + 5)) AS idx, idx + event_id % 3 - 1 AS known FROM ev WHERE t = 'signup'), bw AS (SELECT DISTINCT sid, idx FROM bo WHERE known < idx) SELECT bl.sid, bl.idx, CASE WHEN bw.sid IS NULL THEN v END AS v, CASE WHEN bw.sid IS NOT NULL AND kind = 'measured' THEN 'empty_response' ELSE kind END AS kind, evidence, bw.sid IS NOT NULL AS bonus_window FROM bl LEFT JOIN bw ON bw.sid = bl.sid AND bw.idx = bl.idx WHERE reject_reason IS NULL", "calendar")
def d14_masked(spark, sf):
    e, b = balances(spark, sf)
    bonuses = e.where("t = 'signup'").select("sid", "idx", (C("idx") + C("event_id") % 3 - 1).alias("known"))
    m = cells.masked_balances(b.where("reject_reason IS NULL"), bonuses, "sid", "idx", "v", 5)
    return m.select("sid", "idx", "v", "fill.kind", "fill.evidence", "bonus_window")


@query("d15_stacked_flows", _E + _COVER.format(n="ca", t="click") + _COVER.format(n="cb", t="error") + """, lg AS (SELECT sid, idx, 'a' AS src, v AS own, v * 2 AS pension FROM ev WHERE t = 'purchase' UNION ALL SELECT sid, idx, 'b', v, NULL FROM ev WHERE t = 'view')
    SELECT lg.sid, lg.idx, src, own, round(pension, 4) AS pension, 'measured' AS kind, 'none' AS evidence, CASE WHEN g.sid IS NULL THEN CASE WHEN lg.idx < 2 THEN 'pre_calendar' ELSE 'off_grid' END END AS reject_reason FROM lg LEFT JOIN grid g ON g.sid = lg.sid AND g.idx = lg.idx
    UNION ALL SELECT g.sid, g.idx, CASE WHEN ca.p IS NOT NULL THEN 'a' WHEN cb.p IS NOT NULL THEN 'b' END, NULL, NULL, CASE coalesce(ca.p, cb.p) WHEN 2 THEN 'src_omitted' WHEN 1 THEN 'empty_response' ELSE 'not_collected' END, CASE WHEN ca.p = 2 THEN 'shard_done' WHEN ca.p = 1 THEN 'shard_empty' WHEN cb.p = 2 THEN 'unit_ok' WHEN cb.p = 1 THEN 'unit_empty' ELSE 'none' END, NULL FROM grid g LEFT JOIN ca ON ca.sid = g.sid AND ca.idx = g.idx LEFT JOIN cb ON cb.sid = g.sid AND cb.idx = g.idx WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.sid = g.sid AND lg.idx = g.idx)""", "calendar")
def d15_flows(spark, sf):
    e, grid = ledger(spark, sf)
    one = source(e, "a", "purchase", "click", "own", "shard_done", "shard_empty")
    one = cells.Source("a", one.rows.withColumn("pension", F.round(C("own") * 2, 4)), ["own", "pension"], ["event_id"], one.windows, "shard_done", "shard_empty")
    return cells.stacked_flows(grid, one, source(e, "b", "view", "error", "own"), "sid", "idx", FIRST).select("sid", "idx", "src", "own", "pension", "fill.kind", "fill.evidence", "reject_reason")
