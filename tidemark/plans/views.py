"""Tables derived from the given ones, each as a DataFrame and as SQL: bars, calendars, panels, facts with a publication date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of each user's events."""
    e = read(spark, sf, "events")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("user_id").alias("sid"), F.col("ts").cast("date").alias("d")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count("*").alias("volume"), F.sum("value").alias("amount"),
    )


def calendar(b: DataFrame) -> DataFrame:
    """Distinct sessions with index, previous and next: one row a day, so one task holds it."""
    w = Window.orderBy("d")
    return b.select("d").distinct().select("d", (F.row_number().over(w) - 1).alias("idx"), F.lag("d").over(w).alias("prev_d"), F.lead("d").over(w).alias("next_d"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """bars with the session index and a sector (sid modulo 5)."""
    b = bars(spark, sf)
    return b.join(F.broadcast(calendar(b).select("d", "idx")), "d").withColumn("sector", F.pmod("sid", F.lit(5)))


def long_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily prices of each supplier over years.

    A supplier has one or two rows a day, so a table of all days, held before and after a shuffle, would be as large as the
    rows. They are sorted by supplier and day after one shuffle instead; what follows by supplier needs no other.
    """
    x = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sid"), F.col("l_shipdate").cast("date").alias("d"), "l_extendedprice", "l_quantity").repartition("sid")
    day = Window.partitionBy("sid", "d")
    x = x.withColumn("__n", F.row_number().over(day.orderBy("l_extendedprice"))).withColumns({"amount": F.sum("l_extendedprice").over(day), "volume": F.sum("l_quantity").over(day)})
    return x.where("__n = 1").select("sid", "d", (F.col("amount") / F.col("volume")).alias("close"), "volume", "amount")


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly sums of each customer's orders, published up to 59 days after the quarter's end."""
    o = read(spark, sf, "orders")
    q = o.groupBy(F.col("o_custkey").alias("sid"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("q")).agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n"))
    end = F.last_day(F.add_months("q", 2))
    return q.withColumn("period_end", end).withColumn("available_date", F.date_add("period_end", F.pmod("sid", F.lit(60)).cast("int")))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("sid"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("payload"), F.col("o_totalprice").alias("value"))


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    """supplier -> nation (l2) -> region (l1)."""
    s, n, r = (read(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("s_suppkey").alias("sid"), F.col("n_name").alias("l2"), F.col("r_name").alias("l1"), "s_acctbal")


def curve(spark: SparkSession, sf: str) -> DataFrame:
    """An account for each event type: 100000 and the values so far, by day."""
    e = read(spark, sf, "events")
    day = e.groupBy(F.col("event_type").alias("account"), F.col("ts").cast("date").alias("d")).agg(F.sum(F.col("value") - 10).alias("gain"))
    w = Window.partitionBy("account").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("account", "d", (F.lit(100000.0) + F.sum("gain").over(w)).alias("equity"))


SQL = {
    "bars": """SELECT user_id AS sid, CAST(ts AS DATE) AS d, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY ts, event_id) AS close, count(*) AS volume, sum(value) AS amount FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "calendar": """SELECT d, row_number() OVER (ORDER BY d) - 1 AS idx, lag(d) OVER (ORDER BY d) AS prev_d, lead(d) OVER (ORDER BY d) AS next_d
        FROM (SELECT DISTINCT d FROM bars)""",
    "panel": "SELECT b.*, c.idx, b.sid % 5 AS sector FROM bars b JOIN calendar c USING (d)",
    "long_bars": """SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS close,
        sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "fundamentals": """SELECT *, period_end + CAST(sid % 60 AS INTEGER) AS available_date FROM (
        SELECT *, last_day(CAST(q + INTERVAL 2 MONTH AS DATE)) AS period_end FROM (
        SELECT o_custkey AS sid, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, sum(o_totalprice) AS revenue, count(*) AS n FROM orders GROUP BY ALL))""",
    "versions": "SELECT o_custkey AS sid, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq, o_orderstatus AS payload, o_totalprice AS value FROM orders",
    "sectors": """SELECT s_suppkey AS sid, n_name AS l2, r_name AS l1, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "curve": """SELECT account, d, 100000.0 + sum(gain) OVER (PARTITION BY account ORDER BY d) AS equity FROM (
        SELECT event_type AS account, CAST(ts AS DATE) AS d, sum(value - 10) AS gain FROM events GROUP BY ALL)""",
}
_NEEDS = {"calendar": ["bars"], "panel": ["bars", "calendar"]}


def with_views(sql: str, views: list[str]) -> str:
    """The SQL with the definitions of the views that it reads."""
    order: list[str] = []
    for v in views:
        for x in [*_NEEDS.get(v, []), v]:
            if x not in order:
                order.append(x)
    return (f"WITH {', '.join(f'{v} AS ({SQL[v]})' for v in order)} " if order else "") + sql.strip()
