"""Token totals kept up by signed changes.

A change is a document with a sign: +1 enters it, -1 takes it out, and a revision is both, with the old and the new text.
A batch of changes is reduced to its delta, the signed numbers of documents and tokens by source, language and tokenizer
version, and written to a folder of its own; a marker named by the batch, which only one writer can create, then names the
folder. So a batch is there whole or not at all, and committing it again changes nothing. Totals are the sums over all batches: additive,
in any order, without reading a document again. Totals below nothing, from deleting what was never entered, are refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import scratch, whole_text
from ._tokens import library_encoder

KEYS = ["source", "lang", "tokenizer"]


def counted(changes: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """(sign, source, lang, tokenizer, tokens) of each change and tokenizer version (name -> vocabulary file)."""
    names = list(tokenizers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders = [library_encoder(tokenizers[n]) for n in names]
        for b in batches:
            for name, encoder in zip(names, encoders, strict=True):
                size = np.dtype(encoder.dtype).itemsize
                yield b[["sign", "source", "lang"]].assign(tokenizer=name, tokens=[len(x) // size for x in encoder.encode(b["text"])])

    picked = changes.select(F.col("sign").cast("int").alias("sign"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    return picked.mapInPandas(run, "sign int, source string, lang string, tokenizer string, tokens long")


def _claim(spark: SparkSession, marker: str, folder: str) -> bool:
    """Creates the marker with the folder's name in it, unless it is there; whether this call made it.

    Creating a file that must not exist is one step of the file system (of HDFS' name node, of a store's conditional put;
    a local disk checks first), so of two writers of one batch one is told that it is too late.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(marker)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(path):
            return False
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    return True


def commit(changes: DataFrame, batch: int, root: str, tokenizers: dict[str, str]) -> bool:
    """Writes the delta of a batch of changes (sign, source, lang, text) under root, unless this batch is there; whether it wrote.

    The delta goes to a folder of its own, then the batch's marker names that folder: what no marker names doesn't count. A
    commit that dies on the way, or comes second, leaves a folder that readers pass over, and can be repeated.
    """
    spark = changes.sparkSession
    marker, folder = f"{root}/commits/{batch}", uuid.uuid4().hex
    path = spark._jvm.org.apache.hadoop.fs.Path(marker)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    # Spark adds up inside each task first, so a hot source sends a few rows a task
    delta = counted(changes, tokenizers).groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
    delta.coalesce(1).write.parquet(f"{root}/deltas/{folder}")
    return _claim(spark, marker, folder)


def totals(spark: SparkSession, root: str) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) over all committed batches; groups without documents are left out."""
    deltas = spark.read.schema("source string, lang string, tokenizer string, docs long, tokens long").option("recursiveFileLookup", True).parquet(f"{root}/deltas")
    deltas = deltas.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "/deltas/([0-9a-f]+)/", 1))
    committed = spark.read.text(f"{root}/commits").select(F.col("value").alias("folder"))
    sums = deltas.join(committed, "folder", "left_semi").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    there = F.assert_true((F.col("docs") >= 0) & (F.col("tokens") >= 0), "more was deleted than entered").isNull()
    return sums.where(there & ((F.col("docs") != 0) | (F.col("tokens") != 0)))


def history(docs: DataFrame) -> list[DataFrame]:
    """Four batches of changes after which the documents are exactly those of docs.

    All enter, a tenth of them as a draft that has their source's name as a further line; the drafts are revised; another
    tenth is deleted; it enters again. The tenths are told by crc32 of doc_id modulo 10 (7 and 3).
    """
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10))
    d = docs.select("doc_id", "source", "lang", "text")
    draft = F.concat_ws("\n", "text", "source")
    signed = lambda x, s: x.withColumn("sign", F.lit(s))
    late, gone = d.where(part == 7), d.where(part == 3)
    return [signed(d.withColumn("text", F.when(part == 7, draft).otherwise(F.col("text"))), 1), signed(late.withColumn("text", draft), -1).unionByName(signed(late, 1)), signed(gone, -1), signed(gone, 1)]


def rollup(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """Totals after committing the batches of history(docs), the second of them twice: the totals of docs as they are.

    Null texts have no tokens; a null source or lang is a group of its own; repeated rows count each; an empty table has
    no totals. Columns but doc_id, source, lang and text are ignored.
    """
    root = scratch(docs.sparkSession, "token-counts")
    batches = history(docs)
    for i, b in [*enumerate(batches), (1, batches[1])]:
        commit(b, i, root, tokenizers)
    return totals(docs.sparkSession, root)
