"""What the operators of this subpackage share: reading tables, written intermediate tables, text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share.

    The folder is spark.checkpoint.dir. Only where that is unset (tests on one machine) a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one computation, deleted together once its result has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for p in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths.clear()


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bucket_of(name: str, n: int) -> Column:
    """crc32 of the column's decimal text, modulo n; null goes with the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(n))


def with_group(rows: DataFrame, keys: list[str], aggregates: list[Column], spread: str, salts: int = 32, having: str = "true") -> DataFrame:
    """rows with aggregates of their group, for groups of any size; only the groups for which having holds.

    The aggregates are combined inside each task first; they come back to the rows of a group under as many salts as its
    rows have (by a hash of the column spread), so a hot group is joined in up to that many tasks. rows is read twice
    and should be a written table.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    mask = F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__mask")
    groups = salted.groupBy(*keys).agg(*aggregates, mask).where(having)
    groups = groups.withColumn("__salt", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), b -> (shiftright(__mask, b) & 1L) = 1L)"))).drop("__mask")
    return salted.join(groups, [*keys, "__salt"]).drop("__salt")
