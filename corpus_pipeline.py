"""From documents to packed sequences: each stage takes (spark, docs, sf_dir) and gives the next one's docs.

All stages but the last return the columns that they got, others than those of documents among them. An empty table gives an
empty one. What null texts, null or repeated doc_ids become is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from tidemark.llm._shared import bucket_of, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of 0.5 at least; null texts and those without letters go.

    Each row is judged by its text alone, so repeated rows and null doc_ids make no difference.
    """
    model = language_id.fit(docs, bucket_of("doc_id", 5) != 0)
    told = language_id.predict(docs, model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id; null counts as empty, a null doc_id as the least."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near-duplicates; all rows that repeat that doc_id.

    Rows without a doc_id go where their class has a row with one, unless some class has none: then they all stay.
    """
    keep = near_dedup.classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; a null text stays null, and no row goes."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences of 4096 tokens; null is packed as the empty text, repeated rows each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, max_len=4096)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packed)]

#: SQL can express neither the classifier nor the signatures; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
