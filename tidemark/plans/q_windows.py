"""Window, ranking and aggregate operators over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ranks, series
from tidemark.operators import aggregates, windows

from . import views
from .registry import query

C = F.col
BY = ["sid"]


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(
    "minimum_slice",
    """, m AS (SELECT sid, d, lag(close, 1) OVER w / nullif(lag(close, 5) OVER w, 0) - 1 AS mom, count(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n
        FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx)),
    v AS (SELECT sid, d, CASE WHEN n = 5 THEN mom END AS mom FROM m),
    r AS (SELECT sid, d, mom, (rank() OVER (PARTITION BY d ORDER BY mom) + (count(*) OVER (PARTITION BY d, mom) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY d) - 1, 1) AS score FROM v WHERE mom IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, sid) AS rank FROM r)
    SELECT d, sid, round(mom, 6) AS mom, round(score, 6) AS score, rank FROM k WHERE rank <= 10""",
    "panel",
)
def minimum_slice(spark, sf):
    p = views.panel(spark, sf).select("sid", "d", "idx", "close")
    m = p.withColumn("mom", series.ts_momentum(BY, "idx", C("close"), 5, 1))
    s = m.withColumn("score", ranks.rank_avg(["d"], C("mom"))).where(C("score").isNotNull())
    top = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("score"), "sid"))
    return s.withColumn("rank", top).where("rank <= 10").select("d", "sid", r6(C("mom"), "mom"), r6(C("score"), "score"), "rank")


@query("w01_islands", """, r AS (SELECT sid, idx, idx - row_number() OVER (PARTITION BY sid ORDER BY idx) AS run FROM panel), s AS (SELECT sid, min(idx) AS first, max(idx) AS last, count(*) AS n FROM r GROUP BY sid, run)
    SELECT sid, first, last, n, row_number() OVER (PARTITION BY sid ORDER BY first) AS span_seq FROM s""", "panel")
def w01(spark, sf):
    return windows.islands(views.panel(spark, sf), BY, "idx")


@query("w01_merged_windows", """, x AS (SELECT sid, idx AS lo, idx + volume % 4 AS hi FROM panel), f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY sid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM x),
    g AS (SELECT *, sum(new) OVER (PARTITION BY sid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT sid, CAST(island AS BIGINT) AS island, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY sid, island""", "panel")
def w01b(spark, sf):
    x = views.panel(spark, sf).select("sid", C("idx").alias("lo"), (C("idx") + C("volume") % 4).alias("hi"))
    return windows.merged_windows(x, BY, "lo", "hi")


@query("w02_last_event_idx", "SELECT sid, d, max(CASE WHEN volume >= 3 THEN idx END) OVER (PARTITION BY sid ORDER BY idx) AS last_idx FROM panel", "panel")
def w02(spark, sf):
    return views.panel(spark, sf).select("sid", "d", series.last_event_idx(BY, "idx", C("volume") >= 3, "idx").alias("last_idx"))


@query("w03_adv", "SELECT sid, d, CASE WHEN count(amount) OVER w = 5 THEN round(avg(amount) OVER w, 6) END AS adv FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx ROWS 4 PRECEDING)", "panel")
def w03(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(series.ts_mean(BY, "idx", C("amount"), 5), "adv"))


@query("w04_high_low_range", "SELECT sid, d, max(high) OVER w AS hi, min(low) OVER w AS lo FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)", "panel")
def w04(spark, sf):
    hi, lo = series.high_low_range(BY, "idx", C("high"), C("low"), 10)
    return views.panel(spark, sf).select("sid", "d", hi.alias("hi"), lo.alias("lo"))


@query("w05_cumprod", "SELECT sid, d, round(product(1 + volume / 100.0) OVER (PARTITION BY sid ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS p FROM panel", "panel")
def w05(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(series.cumprod(BY, "idx", 1 + C("volume") / 100.0), "p"))


@query("w06_revprod", "SELECT sid, d, round(product(1 + volume / 100.0) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p FROM panel", "panel")
def w06(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(series.revprod(BY, "idx", 1 + C("volume") / 100.0), "p"))


@query("w07_prev_session", "SELECT sid, d, CASE WHEN lag(idx) OVER w = idx - 1 THEN lag(close) OVER w END AS prev FROM panel WINDOW w AS (PARTITION BY sid ORDER BY idx)", "panel")
def w07(spark, sf):
    p = views.panel(spark, sf)
    return p.select("sid", "d", windows.previous_session(p, BY, "idx", "close").alias("prev"))


@query("w08_liquidity_rank", "SELECT sid, d, CASE WHEN volume >= 2 THEN round(cume_dist() OVER (PARTITION BY d, volume >= 2 ORDER BY amount), 6) END AS liquidity_rank FROM panel", "panel")
def w08(spark, sf):
    return windows.liquidity_rank(views.panel(spark, sf), ["d"], "amount", C("volume") >= 2).select("sid", "d", r6(C("liquidity_rank"), "liquidity_rank"))


_AVG = "(rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2.0 - 1)"


@query("w09_rank_avg", f"SELECT sid, d, round({_AVG} / greatest(count(*) OVER (PARTITION BY d) - 1, 1), 6) AS r FROM panel", "panel")
def w09(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.rank_avg(["d"], C("volume")), "r"))


@query("w10_pct_rank_100", f"SELECT sid, d, CASE WHEN count(*) OVER (PARTITION BY d) = 1 THEN 50.0 ELSE round({_AVG} * 100 / (count(*) OVER (PARTITION BY d) - 1), 6) END AS r FROM panel", "panel")
def w10(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.pct_rank_100(["d"], C("volume")), "r"))


@query("w11_pct_rank_min", "SELECT sid, d, round(percent_rank() OVER (PARTITION BY d ORDER BY volume), 6) AS r FROM panel", "panel")
def w11(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.pct_rank_min(["d"], C("volume")), "r"))


@query("w12_percentrank_inc", "SELECT sid, d, round((rank() OVER (PARTITION BY d ORDER BY volume) - 1) / nullif(count(*) OVER (PARTITION BY d) - 1, 0), 6) AS r FROM panel", "panel")
def w12(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.percentrank_inc(["d"], C("volume").cast("double")), "r"))


@query("w13_zscore_pop", "SELECT sid, d, CASE WHEN stddev_pop(close) OVER w = 0 THEN 0.0 ELSE round((close - avg(close) OVER w) / stddev_pop(close) OVER w, 6) END AS z FROM panel WINDOW w AS (PARTITION BY d)", "panel")
def w13(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.zscore_pop(["d"], C("close")), "z"))


@query("w14_zscore_winsor", "SELECT sid, d, CASE WHEN count(close) OVER w < 2 OR stddev_samp(close) OVER w = 0 THEN 0.0 ELSE round(greatest(-1.5, least(1.5, (close - avg(close) OVER w) / stddev_samp(close) OVER w)), 6) END AS z FROM panel WINDOW w AS (PARTITION BY d)", "panel")
def w14(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.zscore_winsor(["d"], C("close"), 1.5), "z"))


@query("w15_winsorize", "SELECT sid, d, round(greatest(quantile_cont(close, 0.1) OVER w, least(quantile_cont(close, 0.9) OVER w, close)), 6) AS x FROM panel WINDOW w AS (PARTITION BY d)", "panel")
def w15(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.winsorize(["d"], C("close"), 0.1, 0.9), "x"))


@query("w16_demean", "SELECT sid, d, round(close - avg(close) OVER (PARTITION BY d), 6) AS x, round(close - avg(close) OVER (PARTITION BY d, sector), 6) AS g FROM panel", "panel")
def w16(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.demean(["d"], C("close")), "x"), r6(ranks.demean(["d", "sector"], C("close")), "g"))


@query("w17_group_rank", """, a AS (SELECT sid, d, sector, volume, count(*) OVER (PARTITION BY d, sector) AS k,
        (rank() OVER (PARTITION BY d, sector ORDER BY volume) + (count(*) OVER (PARTITION BY d, sector, volume) - 1) / 2.0 - 1) * 100 / nullif(count(*) OVER (PARTITION BY d, sector) - 1, 0) AS g,
        (rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2.0 - 1) * 100 / nullif(count(*) OVER (PARTITION BY d) - 1, 0) AS u FROM panel)
    SELECT sid, d, round(CASE WHEN k >= 5 THEN coalesce(g, 50) ELSE coalesce(u, 50) END, 6) AS r FROM a""", "panel")
def w17(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(ranks.group_rank(["d"], "sector", C("volume"), 5), "r"))


@query("w18_top_n_capped", """, a AS (SELECT *, row_number() OVER (PARTITION BY d, sector ORDER BY amount DESC, sid) AS i FROM panel), b AS (SELECT d, sid, sector, row_number() OVER (PARTITION BY d ORDER BY amount DESC, sid) AS rank FROM a WHERE i <= 2)
    SELECT * FROM b WHERE rank <= 7""", "panel")
def w18(spark, sf):
    p = views.panel(spark, sf).select("d", "sid", "sector", "amount")
    return windows.top_n_capped(p, ["d"], "sector", [F.desc("amount"), C("sid")], 7, 2).select("d", "sid", "sector", "rank")


@query("w19_final_rank", "SELECT d, sid, CASE WHEN volume >= 2 THEN row_number() OVER (PARTITION BY d, volume < 2 ORDER BY close DESC, sid) END AS rank FROM panel", "panel")
def w19(spark, sf):
    return windows.final_rank(views.panel(spark, sf), ["d"], "close", "sid", C("volume") < 2).select("d", "sid", "rank")


@query("w20_fy_rank", "SELECT sid, q, CASE WHEN q >= DATE '1997-01-01' THEN dense_rank() OVER (PARTITION BY sid, q >= DATE '1997-01-01' ORDER BY q) END AS fy_rank FROM fundamentals", "fundamentals")
def w20(spark, sf):
    return windows.forward_rank(views.fundamentals(spark, sf), BY, "q", C("q") >= F.lit("1997-01-01").cast("date")).select("sid", "q", "fy_rank")


@query("w21_coverage_streak", """, a AS (SELECT sid, d, idx, volume >= 2 AS c, sum(CASE WHEN volume >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY idx) AS g FROM panel)
    SELECT sid, d, CASE WHEN c THEN CAST(sum(CAST(c AS INT)) OVER (PARTITION BY sid, g ORDER BY idx) AS BIGINT) ELSE 0 END AS streak, min(CASE WHEN c THEN idx END) OVER (PARTITION BY sid ORDER BY idx) AS first_covered, max(CASE WHEN c THEN idx END) OVER (PARTITION BY sid ORDER BY idx) AS last_covered FROM a""", "panel")
def w21(spark, sf):
    return windows.coverage_streak(views.panel(spark, sf), BY, "idx", C("volume") >= 2).select("sid", "d", "streak", "first_covered", "last_covered")


@query("w22_period_frontier", "SELECT sid, q, available_date, q = max(q) OVER (PARTITION BY sid ORDER BY available_date) AS frontier FROM fundamentals", "fundamentals")
def w22(spark, sf):
    f = views.fundamentals(spark, sf).withColumn("day", F.unix_date("available_date"))
    return windows.period_frontier(f, BY, "day", "q").select("sid", "q", "available_date", "frontier")


@query("w23_trailing_pct", """, a AS (SELECT sid, d, close AS c, list(close) OVER (PARTITION BY sid ORDER BY idx ROWS 9 PRECEDING) AS l FROM panel)
    SELECT sid, d, CASE WHEN len(l) >= 4 THEN round((len(list_filter(l, lambda x: x < c)) + (len(list_filter(l, lambda x: x = c)) - 1) * 0.5) / greatest(len(l) - 1, 1), 6) END AS p FROM a""", "panel")
def w23(spark, sf):
    return views.panel(spark, sf).select("sid", "d", r6(series.trailing_pct(BY, "idx", C("close"), 10, 4), "p"))


# ---- aggregates


@query("a01_agg_filtered", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_buy, round(sum(value) FILTER (value > 10), 4) AS big FROM events GROUP BY user_id")
def a01(spark, sf):
    e = views.read(spark, sf, "events")
    out = aggregates.agg_filtered(e, ["user_id"], {"n_buy": ("*", C("event_type") == "purchase"), "big": ("value", C("value") > 10)})
    return out.select("user_id", "n_buy", F.round("big", 4).alias("big"))


@query("a02_any_flags", "SELECT user_id, bool_or(event_type = 'error') AS error, bool_or(value > 90) AS high FROM events GROUP BY user_id")
def a02(spark, sf):
    return aggregates.any_flags(views.read(spark, sf, "events"), ["user_id"], {"error": C("event_type") == "error", "high": C("value") > 90})


@query("a03_product", "SELECT sid, round(product(1 + volume / 100.0), 6) AS p FROM panel GROUP BY sid", "panel")
def a03(spark, sf):
    return views.panel(spark, sf).groupBy("sid").agg(r6(F.product(1 + C("volume") / 100.0), "p"))


@query("a04_distinct_lists", "SELECT user_id, count(DISTINCT event_type) AS n, array_to_string(list_sort(list(DISTINCT event_type) FILTER (value > 20)), ',') AS types FROM events GROUP BY user_id")
def a04(spark, sf):
    types = F.array_join(F.array_sort(F.collect_set(F.when(C("value") > 20, C("event_type")))), ",")
    return views.read(spark, sf, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n"), F.when(F.count_if(C("value") > 20) > 0, types).alias("types"))


@query("a05_value_at_latest", "SELECT sid, arg_max(close, idx) AS close, max(d) AS d FROM panel GROUP BY sid", "panel")
def a05(spark, sf):
    return views.panel(spark, sf).groupBy("sid").agg(F.max_by("close", "idx").alias("close"), F.max("d").alias("d"))


@query("a06_ordered_sum", "SELECT sid, round(list_reduce(list_prepend(0.0::DOUBLE, list(amount ORDER BY idx)), lambda a, x: a + x), 6) AS total FROM panel GROUP BY sid", "panel")
def a06(spark, sf):
    return aggregates.ordered_sum(views.panel(spark, sf), ["sid"], "idx", "amount").select("sid", r6(C("total"), "total"))


@query("a07_having", "SELECT sid, count(*) AS n, max(d) AS last FROM panel WHERE volume >= 2 GROUP BY sid HAVING count(*) > 10", "panel")
def a07(spark, sf):
    return views.panel(spark, sf).where("volume >= 2").groupBy("sid").agg(F.count("*").alias("n"), F.max("d").alias("last")).where("n > 10")


@query("a08_median", "SELECT d, round(median(close), 6) AS m FROM panel GROUP BY d", "panel")
def a08(spark, sf):
    return views.panel(spark, sf).groupBy("d").agg(r6(F.median("close"), "m"))


@query("a09_quantile", "SELECT d, round(quantile_cont(close, 0.3), 6) AS q FROM panel GROUP BY d", "panel")
def a09(spark, sf):
    return views.panel(spark, sf).groupBy("d").agg(r6(F.percentile("close", 0.3), "q"))


@query("a10_percentile_nearest", "SELECT d, list_sort(list(close))[CAST(greatest(1, ceil(count(*) * 0.9)) AS INT)] AS value FROM panel GROUP BY d", "panel")
def a10(spark, sf):
    return aggregates.percentile_nearest(views.panel(spark, sf), ["d"], "close", 0.9)


@query("a11_moments", """SELECT sid, round(avg(close), 6) AS mean, round(stddev_pop(close), 6) AS sd_pop, round(stddev_samp(close), 6) AS sd, round(var_samp(close), 4) AS variance,
    round(covar_samp(close, volume), 6) AS covariance, round(regr_slope(close, volume), 5) AS slope FROM panel GROUP BY sid HAVING count(DISTINCT volume) > 1""", "panel")
def a11(spark, sf):
    p = views.panel(spark, sf)
    some = p.groupBy("sid").agg(F.countDistinct("volume").alias("k")).where("k > 1").select("sid")
    m = aggregates.moments(p.join(some, "sid", "left_semi"), ["sid"], "close", "volume")
    return m.select("sid", r6(C("mean"), "mean"), r6(C("sd_pop"), "sd_pop"), r6(C("sd"), "sd"), F.round("variance", 4).alias("variance"), r6(C("covariance"), "covariance"), F.round("slope", 5).alias("slope"))


@query("a12_higher_moments", """, m AS (SELECT l_suppkey AS sid, l_quantity AS x, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS mu FROM lineitem)
    SELECT sid, round(avg((x - mu) ** 3) / avg((x - mu) ** 2) ** 1.5, 6) AS skew, round(avg((x - mu) ** 4) / avg((x - mu) ** 2) ** 2, 6) AS kurt FROM m GROUP BY sid""".removeprefix(",").replace(" m AS", "WITH m AS", 1))
def a12(spark, sf):
    x = views.read(spark, sf, "lineitem").select(C("l_suppkey").alias("sid"), "l_quantity")
    return aggregates.higher_moments(x, ["sid"], "l_quantity").select("sid", r6(C("skew"), "skew"), r6(C("kurt"), "kurt"))


@query("a13_weighted_mean", "SELECT d, sector, round(sum(close * volume) / sum(volume), 6) AS wmean FROM panel GROUP BY d, sector", "panel")
def a13(spark, sf):
    return aggregates.weighted_mean(views.panel(spark, sf), ["d", "sector"], "close", "volume").select("d", "sector", r6(C("wmean"), "wmean"))


@query("a14_sector_rollup", "SELECT l1, l2, grouping_id(l1, l2) AS level, count(*) AS n, round(sum(s_acctbal), 4) AS balance FROM sectors GROUP BY ROLLUP (l1, l2)", "sectors")
def a14(spark, sf):
    return views.sectors(spark, sf).rollup("l1", "l2").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 4).alias("balance"))


@query("a15_weighted_available", """SELECT sid, d, round((coalesce(0.5 * close, 0) + CASE WHEN volume >= 2 THEN 0.3 * amount ELSE 0 END + CASE WHEN sector > 1 THEN 0.2 * low ELSE 0 END) / (0.5 + CASE WHEN volume >= 2 THEN 0.3 ELSE 0 END + CASE WHEN sector > 1 THEN 0.2 ELSE 0 END), 6) AS x FROM panel""", "panel")
def a15(spark, sf):
    p = views.panel(spark, sf).select("sid", "d", C("close").alias("a"), F.when(C("volume") >= 2, C("amount")).alias("b"), F.when(C("sector") > 1, C("low")).alias("c"))
    return p.select("sid", "d", r6(aggregates.weighted_available({"a": 0.5, "b": 0.3, "c": 0.2}), "x"))


@query("a16_field_coverage", """, q AS (SELECT d, ntile(5) OVER (PARTITION BY d ORDER BY amount, sid) AS quintile, volume >= 2 AS has FROM panel)
    SELECT quintile, count(*) AS n, count(*) FILTER (has) AS covered FROM q GROUP BY quintile""", "panel")
def a16(spark, sf):
    q = views.panel(spark, sf).select(F.ntile(5).over(Window.partitionBy("d").orderBy("amount", "sid")).alias("quintile"), (C("volume") >= 2).alias("has"))
    return q.groupBy("quintile").agg(F.count("*").alias("n"), F.count_if("has").alias("covered"))


@query("a17_bucket_sums", "SELECT sid, CAST(date_trunc('week', d) AS DATE) AS bucket, round(sum(amount), 4) AS total FROM long_bars GROUP BY ALL", "long_bars")
def a17(spark, sf):
    return aggregates.bucket_sums(views.long_bars(spark, sf), ["sid"], "d", "amount", "week").select("sid", "bucket", F.round("total", 4).alias("total"))
