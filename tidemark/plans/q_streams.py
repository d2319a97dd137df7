"""Streams over the events table, drained with availableNow and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.streaming import streams

from . import views
from .registry import query

C = F.col
_own: list[str] = []


def folder(spark) -> str:
    """A new path in the shared checkpoint folder; on one machine, where none is set, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own[0]
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


END = "2100-01-01 00:00:00"


def events(spark, sf, close=False):
    """The events table as a stream of its file; times are made instants, which watermarks need.

    With close, a last row at END (user -1, no type) moves the watermark past all others, so that nothing stays behind.
    """
    flat = views.read(spark, sf, "events")

    s = spark.readStream.schema(flat.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    if close:
        own = folder(spark)
        last = {"user_id": F.lit(-1), "ts": F.lit(END), "event_type": F.lit("")}
        spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in flat.schema]).write.parquet(own)
        s = s.unionByName(spark.readStream.schema(flat.schema).parquet(own))
    return s.withColumn("ts", C("ts").cast("timestamp"))


def drained(spark, s):
    f = folder(spark)
    return streams.drain(s, f"{f}/out", f"{f}/state")


@query("st1_first_version", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def st1(spark, sf):
    s = streams.stream_first_version(events(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    return drained(spark, s.select("user_id", "event_type", "ts")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def plain(d, *names):
    """Instants as local times, as the table has them."""
    return d.select(*[C(c).cast("timestamp_ntz").alias(c) if c in names else C(c) for c in d.columns])


@query("st2_fold_consecutive", "SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def st2(spark, sf):
    q = streams.stream_fold_consecutive(folder(spark), "user_id", "ts", "event_type", "1 hour")
    q.run(events(spark, sf, True))
    return plain(q.rows(spark).where("user_id <> -1"), "ts")


@query("st3_candles", "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY ALL")
def st3(spark, sf):
    d = drained(spark, streams.stream_candles(events(spark, sf, True), "user_id", "ts", "value", ["ts", "event_id"], "1 day", "1 hour"))
    return plain(d.where("user_id <> -1"), "start")


@query("st4_flow", "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY * k AS start, round(sum(value), 4) AS flow FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def st4(spark, sf):
    d = drained(spark, streams.stream_flow(events(spark, sf, True), "event_type", "ts", "value", "2 days", "1 day", "1 hour"))
    return plain(d.where("event_type <> ''").withColumn("flow", F.round("flow", 4)), "start")


@query("st5_runs", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run")
def st5(spark, sf):
    d = drained(spark, streams.stream_runs(events(spark, sf, True), "user_id", "ts", "6 hours", "1 hour"))
    return plain(d.where("user_id <> -1"), "start", "end")


@query("st6_late", "WITH e AS (SELECT *, event_id % 3 AS batch FROM events), h AS (SELECT b.batch, e.user_id, max(e.ts) AS high FROM e, (SELECT unnest([1, 2]) AS batch) b WHERE e.batch < b.batch GROUP BY ALL) SELECT e.batch, coalesce(e.ts < h.high - INTERVAL 5 DAYS, false) AS late, count(*) AS n, min(e.event_id) AS first FROM e LEFT JOIN h ON h.batch = e.batch AND h.user_id = e.user_id GROUP BY ALL")
def st6(spark, sf):
    """Three batches, each what has come since the one before."""
    root = folder(spark)
    e = views.read(spark, sf, "events")
    q = streams.Quarantine(root, "user_id", "ts", "5 DAYS")
    for n in range(3):
        e.where(C("event_id") % 3 == n).write.mode("append").parquet(f"{root}/source")
        q.run(spark.readStream.schema(e.schema).parquet(f"{root}/source"))
    return q.rows(spark).groupBy("batch", "late").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


LEVELS_SQL = """, p AS (SELECT *, max(e) OVER (PARTITION BY k, era ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM x), l AS (SELECT *, 1 - e / peak AS loss FROM p),
    b AS (SELECT *, coalesce(lag(loss) OVER (PARTITION BY k, era ORDER BY t), 0) < {halt} AND loss >= {halt} AS crossed FROM l), c AS (SELECT *, bool_or(crossed) OVER (PARTITION BY k, spell ORDER BY t ROWS UNBOUNDED PRECEDING) AS halted FROM b)"""


@query("st7_drawdown", "WITH x AS (SELECT user_id AS k, ts AS t, value + 100 AS e, 0 AS era, 0 AS spell FROM events)" + LEVELS_SQL.format(halt=0.5) + ", r AS (SELECT *, last_value(CASE WHEN loss >= 0.3 THEN true WHEN loss < 0.05 THEN false END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t, e ROWS UNBOUNDED PRECEDING) AS reducing FROM c) SELECT k AS account, t AS ts, CASE WHEN halted THEN 3 WHEN reducing THEN 2 WHEN loss >= 0.1 THEN 1 ELSE 0 END AS level FROM r")
def st7(spark, sf):
    s = events(spark, sf, True).select(C("user_id").alias("account"), "ts", (F.coalesce("value", F.lit(0.0)) + 100).alias("equity"))
    q = streams.stream_drawdown(folder(spark), "account", "ts", "equity", (0.1, 0.3, 0.5), 0.05, "1 hour")
    q.run(s)
    return plain(q.rows(spark).where("account <> -1"), "ts")
