"""Vendor blobs, written builds, events, coverage, composites, row accounting."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import joins, quality, technical, versions, windows
from tidemark.sources import tables

from . import views
from .q_streams import folder
from .q_time import two_builds
from .registry import query

C = F.col


def rnd(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else C(c) for c in df.columns])


@query("s01_read_build", "SELECT year(d) AS year, count(*) AS n, min(d) AS first FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) WHERE year(d) IN (1996, 1998) GROUP BY 1")
def s01(spark, sf):
    """Written by year and read by a list of partitions."""
    root = folder(spark)
    x = views.read(spark, sf, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("i"), C("l_shipdate").cast("date").alias("d"))
    tables.write_build(x, root, "d", ["k", "i"])
    return tables.read_build(spark, root, ["year=1996", "year=1998"]).groupBy("year").agg(F.count("*").alias("n"), F.min("d").alias("first"))


@query("s02_read_stage", "SELECT year(d) AS year, count(*) AS n, count(*) FILTER (year(d) >= 1998) AS with_tax FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1")
def s02(spark, sf):
    """Two writes of one table, the first without a column."""
    root = folder(spark)
    x = views.read(spark, sf, "lineitem").select("l_orderkey", "l_tax", F.year("l_shipdate").alias("year"))
    x.where("year < 1998").drop("l_tax").write.partitionBy("year").parquet(root)
    x.where("year >= 1998").write.mode("append").partitionBy("year").parquet(root)
    return tables.read_stage(spark, root).groupBy("year").agg(F.count("*").alias("n"), F.count("l_tax").alias("with_tax"))


@query("s03_bars_csv", "SELECT CAST(sid AS VARCHAR) AS symbol, d AS session, round(close, 4) AS close, volume FROM bars", "bars")
def s03(spark, sf):
    root = folder(spark)
    b = views.bars(spark, sf).select(C("sid").cast("string").alias("symbol"), C("d").alias("session"), *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")
    b.write.option("header", True).csv(root)
    return tables.read_bars_csv(spark, root).where("_corrupt_record IS NULL").select("symbol", "session", "close", "volume")


@query("s04_bars_parquet", "SELECT CAST(sid AS VARCHAR) AS symbol, d AS session, close FROM bars WHERE sid IN (1, 2, 3) AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", "bars")
def s04(spark, sf):
    root = folder(spark)
    views.bars(spark, sf).withColumn("symbol", C("sid").cast("string")).withColumn("session", C("d")).write.parquet(root)
    return tables.read_bars_parquet(spark, root, ["1", "2", "3"], datetime.date(2024, 1, 5), datetime.date(2024, 1, 20)).select("symbol", "session", "close")


@query("s08_decode_periodic", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'E' END AS kind, count(*) AS n FROM orders GROUP BY ALL")
def s08(spark, sf):
    """Labels such as 1998.03(E), split into period and kind."""
    label = F.concat(F.date_format("o_orderdate", "yyyy.MM"), F.lit("("), F.when(C("o_orderstatus") == "F", "A").otherwise("E"), F.lit(")"))
    part = lambda i: F.regexp_extract("label", r"^(\d{4})\.(\d{2})\(([AE])\)$", i)
    d = views.read(spark, sf, "orders").select(label.alias("label")).select(part(1).cast("long").alias("year"), part(2).cast("long").alias("month"), part(3).alias("kind"))
    return d.groupBy("year", "month", "kind").agg(F.count("*").alias("n"))


@query("s10_decode_statements", "SELECT o_custkey AS id, CAST(slot AS INT) AS slot, round(v, 2) AS v FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS slot, o_totalprice AS v FROM orders)")
def s10(spark, sf):
    """Wide slots of a JSON array, a row each."""
    o = views.read(spark, sf, "orders").groupBy(C("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    blob = o.select("id", F.to_json(F.struct(F.transform("a", lambda x: x["o_totalprice"]).alias("values"))).alias("json"))
    d = blob.select("id", F.posexplode(F.from_json("json", "values array<double>")["values"]).alias("slot", "v"))
    return rnd(d, "v", places=2)


@query("s12_decode_components", "SELECT n_regionkey AS sector, n_nationkey AS id, n_name AS name FROM nation")
def s12(spark, sf):
    n = views.read(spark, sf, "nation")
    blob = n.groupBy(C("n_regionkey").alias("sector")).agg(F.to_json(F.collect_list(F.struct(C("n_nationkey").alias("id"), C("n_name").alias("name")))).alias("json"))
    d = blob.select("sector", F.explode(F.from_json("json", "array<struct<id:int,name:string>>")).alias("x"))
    return d.select("sector", "x.id", "x.name")


@query("s20_cross_survey", """WITH a AS (SELECT o_custkey AS sid, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey AS sid, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT 'v' AS "column", count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS "both", count(*) FILTER (b.v IS NULL) AS left_only, count(*) FILTER (a.v IS NULL) AS right_only, count(*) FILTER (abs(a.v - b.v) <= 1e-9 * greatest(abs(a.v), abs(b.v))) AS equal FROM a FULL JOIN b ON a.sid = b.sid""")
def s20(spark, sf):
    o = views.read(spark, sf, "orders").withColumnRenamed("o_custkey", "sid")
    a, b = (d.groupBy("sid").agg(F.sum("o_totalprice").alias("v")) for d in (o.where("o_orderstatus <> 'P'"), o))
    return quality.cross_survey(a, b, ["sid"], ["v"])


@query("d06_corp_event", """, e AS (SELECT user_id AS sid, CAST(ts AS DATE) + 1 AS d, event_id, CASE WHEN event_id % 7 = 0 THEN 1 + event_id % 4 ELSE 1 END AS ratio FROM events WHERE event_type = 'signup'), f AS (SELECT sid, d, arg_min(ratio, event_id) AS ratio, count(*) AS n_src_rows FROM e GROUP BY ALL)
    SELECT f.sid, f.d, f.ratio, f.n_src_rows, c.d AS effective, CASE WHEN c.d IS NULL THEN 'after_calendar' WHEN f.ratio = 1 THEN 'no_change' END AS reject_reason FROM f ASOF LEFT JOIN calendar c ON f.d <= c.d""", "calendar")
def d06(spark, sf):
    """Events with the first session they can take effect on."""
    e = views.read(spark, sf, "events").where("event_type = 'signup'")
    e = e.select(C("user_id").alias("sid"), F.date_add(C("ts").cast("date"), 1).alias("d"), "event_id", F.when(C("event_id") % 7 == 0, 1 + C("event_id") % 4).otherwise(1).alias("ratio"))
    one = versions.first_version(e, ["sid", "d"], ["event_id"])
    cal = views.calendar(views.bars(spark, sf)).select("d", C("d").alias("effective"))
    j = joins.scheduled(one.select("sid", "d", "ratio", "n_src_rows"), "d", cal, ["effective"], forward=True)
    reason = F.when(C("effective").isNull(), "after_calendar").when(C("ratio") == 1, "no_change")
    return j.select("sid", "d", "ratio", "n_src_rows", "effective", reason.alias("reject_reason"))


@query("d19_coverage_daily", ", g AS (SELECT s.sid, c.idx, b.d IS NOT NULL AS c FROM (SELECT DISTINCT sid FROM bars) s CROSS JOIN calendar c LEFT JOIN bars b ON b.sid = s.sid AND b.d = c.d), r AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY idx) AS k FROM g) SELECT sid, idx, CASE WHEN c THEN CAST(sum(CAST(c AS INT)) OVER (PARTITION BY sid, k ORDER BY idx) AS BIGINT) ELSE 0 END AS streak FROM r", "calendar")
def d19(spark, sf):
    b = views.bars(spark, sf)
    grid = b.select("sid").distinct().withColumn("k", F.lit(1)).join(F.broadcast(views.calendar(b).select("d", "idx").withColumn("k", F.lit(1))), "k").drop("k")
    g = grid.join(b.select("sid", "d", F.lit(True).alias("c")), ["sid", "d"], "left").withColumn("c", F.coalesce("c", F.lit(False)))
    return windows.coverage_streak(g, ["sid"], "idx", C("c")).select("sid", "idx", "streak")


@query("d30_factor_inputs", ", f AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY q DESC) AS i FROM fundamentals WHERE available_date <= DATE '1999-12-31') SELECT s.sid, s.l1, s.l2, f.q, round(f.revenue, 4) AS revenue FROM sectors s LEFT JOIN f ON f.sid = s.sid AND f.i = 1", "sectors fundamentals")
def d30(spark, sf):
    known = views.fundamentals(spark, sf).where(C("available_date") <= F.lit(datetime.date(1999, 12, 31)))
    f = versions.latest_per_key(known, ["sid"], ["q"]).select("sid", "q", F.round("revenue", 4).alias("revenue"))
    return views.sectors(spark, sf).select("sid", "l1", "l2").join(f, "sid", "left")


def _r(x):
    return f"(rank() OVER (PARTITION BY d ORDER BY {x}) + (count(*) OVER (PARTITION BY d, {x}) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY d) - 1, 1)"


@query("m14_price_composite", f"SELECT sid, d, round(({_r('close')} + {_r('amount')} + {_r('volume')}) / 3, 6) AS score FROM panel", "panel")
def m14(spark, sf):
    one = lambda c: ranks.rank_avg(["d"], C(c))
    return views.panel(spark, sf).select("sid", "d", F.round((one("close") + one("amount") + one("volume")) / 3, 6).alias("score"))


@query("m15_core_satellite", ", k AS (SELECT idx, sid, row_number() OVER (PARTITION BY idx ORDER BY amount DESC, sid) AS r FROM panel), b AS (SELECT k.*, p.r AS before FROM k LEFT JOIN k p ON p.sid = k.sid AND p.idx = k.idx - 1), s AS (SELECT * FROM b WHERE r <= 3 OR (r <= 5 AND before <= 3)) SELECT idx, sid, round(CASE WHEN r <= 3 THEN 0.7 / count(*) FILTER (r <= 3) OVER (PARTITION BY idx) ELSE 0.3 / count(*) FILTER (r > 3) OVER (PARTITION BY idx) END, 6) AS weight FROM s", "panel")
def m15(spark, sf):
    """The first names are the core; satellites are names that just fell out of it and stay within a band."""
    k = views.panel(spark, sf).select("idx", "sid", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("amount"), "sid")).alias("r"))
    before = k.select((C("idx") + 1).alias("idx"), "sid", C("r").alias("before"))
    s = k.join(before, ["idx", "sid"], "left").where("r <= 3 OR (r <= 5 AND before <= 3)")
    w = Window.partitionBy("idx")
    core = C("r") <= 3
    return s.select("idx", "sid", F.round(F.when(core, 0.7 / F.count_if(core).over(w)).otherwise(0.3 / F.count_if(~core).over(w)), 6).alias("weight"))


@query("m16_alt_features", "SELECT sid, idx, lag(volume, 1) OVER w AS level, lag(volume, 1) OVER w - lag(volume, 4) OVER w AS change, CASE WHEN count(amount) OVER b >= 5 THEN round(sum(amount) OVER b / nullif(close * volume, 0), 5) END AS flow FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx), b AS (PARTITION BY sid ORDER BY idx ROWS 7 PRECEDING)", "panel")
def m16(spark, sf):
    w = Window.partitionBy("sid").orderBy("idx")
    b = w.rowsBetween(-7, 0)
    flow = F.when(F.count("amount").over(b) >= 5, F.round(F.try_divide(F.sum("amount").over(b), C("close") * C("volume")), 5))
    return views.panel(spark, sf).select("sid", "idx", F.lag("volume", 1).over(w).alias("level"), (F.lag("volume", 1).over(w) - F.lag("volume", 4).over(w)).alias("change"), flow.alias("flow"))


#: What the line items are declared to be.
_LINEITEM = {
    **dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], "bigint"), "l_linenumber": "int", **dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "double"),
    **dict.fromkeys(["l_returnflag", "l_linestatus"], "string"), "l_shipdate": "timestamp_ntz",
}


@query("q01_columns", "SELECT 'lineitem' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS problems, count(*) FILTER (length(l_returnflag) > 1 OR length(l_linestatus) > 1) AS too_long FROM lineitem")
def q01(spark, sf):
    x = views.read(spark, sf, "lineitem")
    problems = quality.check_columns(x, _LINEITEM)
    too_long = F.count_if((F.length("l_returnflag") > 1) | (F.length("l_linestatus") > 1))
    return x.agg(F.lit("lineitem").alias("name"), F.count("*").alias("rows"), F.lit(len(problems)).cast("long").alias("problems"), too_long.alias("too_long"))


@query("q02_row_equation", "SELECT count(*) AS n_in, count(DISTINCT (l_orderkey, l_linenumber)) AS n_out, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_dedup, true AS holds FROM lineitem")
def q02(spark, sf):
    x = views.read(spark, sf, "lineitem")
    out = versions.first_version(x.select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    g = out.agg(F.sum("n_src_rows").alias("n_in"), F.count("*").alias("n_out"), F.sum(C("n_src_rows") - 1).alias("n_dedup"))
    return g.withColumn("holds", C("n_out") == C("n_in") - C("n_dedup"))


@query("q08_parse_accounting", "SELECT count(*) AS read, count(*) FILTER (o_orderkey % 7 <> 3) AS kept, count(*) FILTER (o_orderkey % 7 = 3) AS skipped FROM orders")
def q08(spark, sf):
    raw = views.read(spark, sf, "orders").select(F.when(C("o_orderkey") % 7 == 3, "{").otherwise(F.to_json(F.struct("o_orderkey"))).alias("json"))
    key = F.from_json("json", "o_orderkey long")["o_orderkey"]
    return raw.agg(F.count("*").alias("read"), F.count(key).alias("kept"), F.count_if(key.isNull()).alias("skipped"))


@query("q13_diff_report", """WITH b AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN price * 2 WHEN l_orderkey % 97 = 1 AND l_linenumber = 1 THEN NULL ELSE price END AS price FROM b WHERE NOT (l_orderkey % 97 = 2 AND l_linenumber = 2)),
    j AS (SELECT CASE WHEN a.l_orderkey IS NULL THEN 'removed' WHEN a.price IS NULL THEN 'value_lost' WHEN a.price <> b.price THEN 'changed' ELSE 'same' END AS class FROM b LEFT JOIN a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber) SELECT class, count(*) AS n, class IN ('same', 'changed') AS expected FROM j GROUP BY class""")
def q13(spark, sf):
    before, after = two_builds(spark, sf)
    d = joins.diff_builds(before, after, ["l_orderkey", "l_linenumber"], ["price"])
    same = C("common") - C("price_changed") - C("price_lost") - C("price_gained")
    kinds = F.array(*[F.struct(F.lit(n).alias("class"), c.alias("n")) for n, c in (("removed", C("removed")), ("value_lost", C("price_lost")), ("changed", C("price_changed")), ("same", same), ("added", C("added")))])
    return d.select(F.inline(kinds)).where("n > 0").withColumn("expected", C("class").isin("same", "changed"))


@query("t12_double_tops", None)
def t12(spark, sf):
    """Two swing highs of nearly the same price with a low between them."""
    p = technical.zigzag(views.panel(spark, sf), "sid", "idx", 3, 0.3)
    w = Window.partitionBy("sid").orderBy("idx")
    d = p.withColumn("k1", F.lag("kind", 1).over(w)).withColumn("p2", F.lag("price", 2).over(w)).withColumn("k2", F.lag("kind", 2).over(w))
    hit = (C("kind") == "high") & (C("k1") == "low") & (C("k2") == "high") & (F.abs(C("price") / C("p2") - 1) <= 0.1)
    return d.select("sid", "idx", "price", F.coalesce(hit, F.lit(False)).alias("double_top"))
