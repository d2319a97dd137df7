"""Reading and writing tables: builds by pinned partitions, ledgers with missing columns, CSV, JDBC."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("session", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")], T.StructField("volume", T.LongType())])

_own_folder: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written in the folder that all executors share and read again: lineage ends there.

    The folder is spark.checkpoint.dir. Only where that is unset, on one machine, a temporary folder stands in.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own_folder[0]
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_build(spark: SparkSession, root: str, partitions: list[str] | None = None) -> DataFrame:
    """A build's table by the list of its partition folders; without a list, all that is under root."""
    if not partitions:
        return spark.read.parquet(root)
    return spark.read.option("basePath", root).parquet(*[f"{root}/{p}" for p in partitions])


def read_stage(spark: SparkSession, root: str) -> DataFrame:
    """A table partitioned by year whose files may lack columns."""
    return spark.read.option("mergeSchema", True).parquet(root)


def read_bars_csv(spark: SparkSession, path: str, schema: T.StructType = BARS, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Bars with a header; lines that don't fit the schema are kept in _corrupt_record."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.csv(path, with_bad, header=True, mode="PERMISSIVE", dateFormat=date_format, columnNameOfCorruptRecord="_corrupt_record")


def read_bars_parquet(spark: SparkSession, path: str, symbols: list[str], start, end) -> DataFrame:
    """Bars of symbols in a range of sessions; a session that a symbol has twice is an error when rows are read."""
    b = spark.read.parquet(path).where(F.col("symbol").isin(symbols) & F.col("session").between(F.lit(start), F.lit(end)))
    twice = b.groupBy("symbol", "session").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in b.columns if c not in ("symbol", "session")])
    ok = F.when(F.col("n") == 1, F.col("session")).otherwise(F.raise_error(F.concat(F.lit("duplicate session of "), F.col("symbol"))).cast("date"))
    return twice.withColumn("session", ok).select(*b.columns)


def read_bars_jdbc(spark: SparkSession, url: str, query: str, column: str, lower, upper, parts: int, properties: dict | None = None) -> DataFrame:
    """A query of a relational store, read in parts by ranges of a column."""
    return spark.read.jdbc(url, f"({query}) AS q", column, lower, upper, parts, properties=properties or {})


def union_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """Ledgers one under another with their tag in _src; columns that one lacks are null."""
    out = None
    for tag, df in tables.items():
        t = df.withColumn("_src", F.lit(tag))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def write_build(df: DataFrame, path: str, day: str, keys: list[str], reject: str | None = None) -> None:
    """Rows by year, sorted by key inside each file; rows with a reject reason beside them."""
    d = df.withColumn("year", F.year(day))
    if reject:
        d.where(F.col(reject).isNotNull()).write.mode("overwrite").parquet(f"{path}_rejects")
        d = d.where(F.col(reject).isNull()).drop(reject)
    # several files a year, so that one year's rows are never one task's
    d.repartition("year", F.pmod(F.xxhash64(*keys), F.lit(8))).sortWithinPartitions("year", *keys).write.mode("overwrite").partitionBy("year").parquet(path)
