"""Incremental forms: versions, candles, flows, runs, late rows and drawdown levels of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

C = F.col


def stream_first_version(s: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are remembered until the watermark is past them."""
    return s.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def stream_candles(s: DataFrame, by: str, time: str, value: str, order: list[str], width: str, delay: str) -> DataFrame:
    """Open, high, low, close and count of each window of a width."""
    at = F.struct(*order)
    g = s.withWatermark(time, delay).groupBy(by, F.window(time, width).alias("w"))
    g = g.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("volume"))
    return g.select(by, C("w.start").alias("start"), "open", "high", "low", "close", "volume")


def stream_flow(s: DataFrame, by: str, time: str, value: str, width: str, slide: str, delay: str) -> DataFrame:
    g = s.withWatermark(time, delay).groupBy(by, F.window(time, width, slide).alias("w")).agg(F.sum(value).alias("flow"))
    return g.select(by, C("w.start").alias("start"), "flow")


def stream_runs(s: DataFrame, by: str, time: str, gap: str, delay: str) -> DataFrame:
    """Runs of rows with no gap: start, end and rows."""
    g = s.withWatermark(time, delay).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(by, C("w.start").alias("start"), C("w.end").alias("end"), "n")


class Batched:
    """A stream handled by micro-batches whose tables lie under root, a folder a table and a batch.

    A batch writes its own folders anew from those of the batch before it, so a batch that is run again changes nothing.
    Tables that only the next batch reads are kept for `keep` batches.
    """

    def __init__(self, root: str, keep: int):
        self.root, self.keep = root, keep

    def _folder(self, spark, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def before(self, spark, table: str, batch_id: int) -> DataFrame | None:
        """The table as of the last batch before this one; None at first."""
        for n in range(batch_id - 1, max(-1, batch_id - 1 - self.keep), -1):
            fs, p = self._folder(spark, f"{self.root}/{table}/batch={n}/_SUCCESS")
            if fs.exists(p):
                return spark.read.parquet(f"{self.root}/{table}/batch={n}")
        return None

    def put(self, d: DataFrame, table: str, batch_id: int) -> None:
        d.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch_id}")

    def drop_old(self, spark, table: str, batch_id: int) -> None:
        if batch_id >= self.keep:
            fs, p = self._folder(spark, f"{self.root}/{table}/batch={batch_id - self.keep}")
            fs.delete(p, True)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def run(self, s: DataFrame) -> None:
        """All that is there now, in one batch or several."""
        q = s.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
        q.awaitTermination()


class InOrder(Batched):
    """Rows of each unit in the order of event time (equal times by value), whatever order they come in.

    A row waits until the watermark, the latest time so far less a delay, is past it; rows that come behind it are dropped.
    step(rows, own) takes the rows that are due, numbered within their unit by __n, with the unit's state of the batch before
    in the struct `own` (null at first); it gives the rows to emit and the columns of the state as each leaves it. All is
    joins and windows by unit, so that a batch of many units costs no call for each.

    Under root: out, waiting, states and high (the latest time).
    """

    def __init__(self, root: str, unit: str, time: str, value: str, delay: str, out: list[str], states: str, step: Callable[[DataFrame, WindowSpec], tuple[DataFrame, list[Column]]], keep: int = 3):
        super().__init__(root, keep)
        self.unit, self.time, self.value, self.delay, self.out, self.states, self.step = unit, time, value, delay, out, states, step

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, unit, time, value = batch.sparkSession, self.unit, self.time, self.value
        past = lambda high: F.lit(high is not None) & (C(time) < F.timestamp_micros(F.lit(high)) - F.expr(f"INTERVAL {self.delay}"))
        highs = self.before(spark, "high", batch_id)
        high = highs.first()[0] if highs is not None else None
        rows = batch.select(unit, time, value).where(~F.coalesce(past(high), F.lit(False)))
        top = batch.agg(F.unix_micros(F.max(time))).first()[0]
        high = max((x for x in (high, top) if x is not None), default=None)
        waiting = self.before(spark, "waiting", batch_id)
        rows = rows if waiting is None else rows.unionByName(waiting)
        due = C(time).isNull() | past(high)  # rows without a time wait for nothing

        known = self.before(spark, "states", batch_id)
        d = rows.where(due)
        if known is None:
            d = d.withColumn("own", F.lit(None).cast(f"struct<{self.states}>"))
        else:
            d = d.join(known.select(unit, F.struct(*[c for c in known.columns if c != unit]).alias("own")), unit, "left")
        order = Window.partitionBy(unit).orderBy(time, value)
        d, after = self.step(d.withColumn("__n", F.row_number().over(order)), order)
        # a unit's last row carries its state
        last = F.lead(F.lit(True)).over(order).isNull()
        names = [x.split(":")[0] for x in self.states.split(", ")]
        d = d.withColumn("__after", F.when(last, F.struct(*[c.alias(n) for c, n in zip(after, names, strict=True)])))
        self.put(d.select(*self.out, "__after"), "out", batch_id)
        self.put(rows.where(~due), "waiting", batch_id)
        new = spark.read.parquet(f"{self.root}/out/batch={batch_id}").where("__after IS NOT NULL").select(unit, "__after.*")
        self.put(new if known is None else new.unionByName(known.join(new, unit, "left_anti")), "states", batch_id)
        self.put(spark.range(1).select(F.lit(high).cast("bigint").alias("high")), "high", batch_id)
        for table in ("waiting", "states", "high"):
            self.drop_old(spark, table, batch_id)

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.root}/out").select(*self.out)


def stream_fold_consecutive(root: str, unit: str, time: str, payload: str, delay: str) -> InOrder:
    """Rows whose payload differs from the one before, in the order of event time."""

    def step(rows, order):
        before = F.when(C("__n") == 1, C("own.last")).otherwise(F.lag(payload).over(order))
        return rows.withColumn("__same", C(payload).eqNullSafe(before)).where("NOT __same"), [C(payload)]

    return InOrder(root, unit, time, payload, delay, [unit, time, payload], "last:string", step)


def stream_drawdown(root: str, account: str, time: str, equity: str, limits: tuple[float, float, float], recover: float, delay: str) -> InOrder:
    """(account, time, level) of each row in the order of event time, by the rules of market.drawdown_state without actions."""
    warn, reduce, halt = limits

    def step(rows, order):
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        d = rows.withColumn("__peak", F.greatest("own.peak", F.max(equity).over(so_far)))
        loss = F.when((C("__peak") == 0) & (C(equity) < 0), float("inf")).otherwise(1 - F.try_divide(C(equity), C("__peak")))
        d = d.withColumn("__loss", loss)
        before = F.when(C("__n") > 1, F.lag("__loss").over(order)).when(C("own").isNull(), 0.0).otherwise(C("own.loss"))
        d = d.withColumn("__crossed", F.coalesce((before < halt) & (C("__loss") >= halt), F.lit(False)))
        says = F.when(C("__loss") >= reduce, True).when(C("__loss") < recover, False)
        no = F.lit(False)
        d = d.withColumns({"__halted": F.max("__crossed").over(so_far) | F.coalesce("own.halted", no), "__reducing": F.coalesce(F.last(says, True).over(so_far), "own.reducing", no)})
        level = F.when(C("__halted"), 3).when(C("__reducing"), 2).when(C("__loss") >= warn, 1).otherwise(0)
        return d.withColumn("level", level), [C("__peak"), C("__loss"), C("__halted"), C("__reducing")]

    return InOrder(root, account, time, equity, delay, [account, time, "level"], "peak:double, loss:double, halted:boolean, reducing:boolean", step)


def split_late(batch: DataFrame, high_water: DataFrame, by: str, time: str, allowed: str) -> tuple[DataFrame, DataFrame]:
    """A micro-batch's rows in time, and those behind what their key had already reached, for foreachBatch."""
    j = batch.join(high_water, by, "left")
    late = F.coalesce(C(time) < C("high") - F.expr(f"INTERVAL {allowed}"), F.lit(False))
    return j.where(~late).drop("high"), j.where(late).drop("high")


class Quarantine(Batched):
    """Micro-batches split into rows in time and late ones, against the time that each key had reached before the batch.

    Under root: in_time, late and high, a folder a batch. A batch writes its own folders anew, from the high-water table of
    the batch before it, so a batch that is run again changes nothing. Old high-water tables are kept for `keep` batches.
    """

    def __init__(self, root: str, by: str, time: str, allowed: str, keep: int = 3):
        super().__init__(root, keep)
        self.by, self.time, self.allowed = by, time, allowed

    def high_before(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """(by, high) as of the last batch before this one; empty at first."""
        high = self.before(batch.sparkSession, "high", batch_id)
        return batch.select(self.by, C(self.time).alias("high")).limit(0) if high is None else high

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        high = self.high_before(batch, batch_id)
        in_time, late = split_late(batch, high, self.by, self.time, self.allowed)
        self.put(in_time, "in_time", batch_id)
        self.put(late, "late", batch_id)
        now = high.unionByName(batch.select(self.by, C(self.time).alias("high"))).groupBy(self.by).agg(F.max("high").alias("high"))
        self.put(now, "high", batch_id)
        self.drop_old(batch.sparkSession, "high", batch_id)

    def rows(self, spark) -> DataFrame:
        """All rows with their batch and whether they were late."""
        read = lambda kind, late: spark.read.option("basePath", f"{self.root}/{kind}").parquet(f"{self.root}/{kind}/batch=*").withColumn("late", F.lit(late))
        return read("in_time", False).unionByName(read("late", True))


def drain(s: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    q = s.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return s.sparkSession.read.schema(s.schema).parquet(path)
