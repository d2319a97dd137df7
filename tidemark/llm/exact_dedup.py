"""Exact deduplication that no hot text can overload.

Copies are combined three times: inside each task before its rows are sent (Spark's partial aggregation), among the rows
of one salt of a digest, and among the salts' winners. Each time the whole text is part of the grouping key, so two texts
with one digest are never taken for the same. A text with n copies sends one row for each task and salt, never n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import whole_text, written

#: Parts that the copies of one text are dealt to.
SALTS = 128


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")


def winners(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, group_size, salts): a row for each distinct text; salts lists where its copies were dealt."""
    d = docs.select(F.col("doc_id"), whole_text().alias("text"))
    d = d.withColumn("digest", digest(F.col("text"))).withColumn("salt", _salt(salts))
    local = d.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return local.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))


def label(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id stays (a row
    with a null doc_id only if all have one); of repeated rows with that doc_id, all are marked kept, as nothing tells
    them apart. Other columns are ignored.
    """
    won = winners(docs, digest, salts)
    found = won.groupBy("digest").agg(
        F.count("*").alias("texts"), *[F.first(c).alias(c) for c in ("keep_id", "group_size", "salts")]
    )
    found = written(found, "distinct-texts")
    by_digest = found.where("texts = 1").select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
    d = docs.select(F.col("doc_id"), whole_text().alias("text")).withColumn("digest", digest(F.col("text"))).withColumn("text_sha256", F.sha2("text", 256))
    out = [
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    ]
    keys = d.select("doc_id", "digest", _salt(salts).alias("salt"), "text_sha256")
    result = keys.join(by_digest, ["digest", "salt"]).select(out)
    collided = found.where("texts > 1").select("digest")
    if not collided.isEmpty():
        # digests that several texts share: here the texts themselves are joined
        texts = won.select("digest", "text", "keep_id", "group_size")
        result = result.unionByName(d.join(collided, "digest", "left_semi").join(texts, ["digest", "text"]).select(out))
    return result


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns: of each text the row with the largest doc_id, one if it is repeated."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    d = docs.select(whole_text().alias("__text"), sha256(whole_text()).alias("__digest"), _salt(SALTS).alias("__salt"), key.alias("__key"), F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.col("text").isNull().alias("__null")).alias("__row"))
    local = d.groupBy("__digest", "__salt", "__text").agg(F.max_by("__row", "__key").alias("__row"), F.max("__key").alias("__key"))
    one = local.groupBy("__digest", "__text").agg(F.max_by("__row", "__key").alias("__row"))
    return one.select(*[F.when(~F.col("__row.__null"), F.col("__text")).alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
