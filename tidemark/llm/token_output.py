"""Token ids as binary segments with Elias-Fano coded document boundaries.

A segment holds whole documents in ascending doc_id order: their ids one after another as little-endian unsigned
integers of 2 or 4 bytes, and where each document ends as an Elias-Fano sequence. Of n boundaries up to u it keeps the
low l = floor(log2(u / n)) bits of each in a packed array and the rest in unary, n + (u >> l) bits, which is within two
bits a boundary of the least possible. select(i) finds the i-th set bit through the counts of each 512-bit block, so no
table of 64-bit offsets is stored. The doc_ids, ascending as well, are
kept in the same way, less the first. Segments are rows (shard, seq, n_docs, n_ids, width, ids, ends, doc_ids ...) of a Parquet
table, because executors may reach storage through Spark only; each is bounded to about segment_ids ids, but a longer
document has one of its own. Shards are ranges of doc_id, so (shard, seq) is the order of the whole array.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import scratch, whole_text
from ._tokens import library_encoder

_HEAD = struct.Struct("<QQB")
_BLOCK = 512


def ef_encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned integers: header (n, u, l), low bits, high bits."""
    v = np.asarray(values, np.uint64)
    n, u = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    bits = np.zeros(n + (u >> low) + 1 if n else 0, np.uint8)
    if n:
        bits[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return _HEAD.pack(n, u, low) + np.packbits(lows, bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes()


class EliasFano:
    """Reads what ef_encode wrote."""

    def __init__(self, data: bytes):
        self.n, self.u, self.low = _HEAD.unpack_from(data)
        at = _HEAD.size + (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(data, np.uint8, at - _HEAD.size, _HEAD.size)
        self.highs = np.frombuffer(data, np.uint8, offset=at)
        self.padded = np.concatenate((self.highs, np.zeros(-len(self.highs) % (_BLOCK // 8), np.uint8)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.padded).reshape(-1, _BLOCK // 8).sum(1, dtype=np.int64))))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low + np.arange(self.low)
        return (((self.lows[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low)).sum(1) if self.low else np.zeros(len(i), np.int64)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at ascending places i: the i-th set bits, found by their blocks' counts, and the low bits beside."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.before, i, "right") - 1
        blocks, row = np.unique(block, return_inverse=True)
        size = _BLOCK // 8
        rows = self.padded.reshape(-1, size)[blocks]
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        # of the set bits of these blocks, one after another, those at the wanted ranks
        ones = np.flatnonzero(bits.ravel())
        starts = np.cumsum(np.bitwise_count(rows).sum(1, dtype=np.int64)) - np.bitwise_count(rows).sum(1, dtype=np.int64)
        at = ones[starts[row] + i - self.before[block]]
        place = blocks[row] * _BLOCK + at % _BLOCK
        return (place - i) << self.low | self._low(i)

    def values(self, portion: int = 1 << 14) -> Iterator[np.ndarray]:
        """All values in order, a portion at a time."""
        for at in range(0, self.n, portion):
            yield self.select(np.arange(at, min(self.n, at + portion)))


_SEGMENT = "shard int, seq int, n_docs long, n_ids long, width int, ids binary, ends binary, doc_ids binary, first_id long, n_null int"


def write_segments(docs: DataFrame, vocabulary: str, end_id: int, path: str, segment_ids: int = 1 << 21, shards: int | None = None) -> None:
    """Encodes every text, appends end_id to each, and writes the segments under path.

    Rows with equal doc_id follow each other in the order of their texts' hashes; null doc_ids come first.
    """
    spark = docs.sparkSession
    n = shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    tie = F.xxhash64("text")
    ordered = picked.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = library_encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        last = np.array([end_id], encoder.dtype).tobytes()
        width = len(last)
        held: list[bytes] = []
        owners: list[int | None] = []
        size, seq = 0, 0

        def segment() -> pd.DataFrame:
            ends = np.cumsum([len(x) // width for x in held])
            named = np.array([o for o in owners if o is not None], np.int64)  # null ids come first
            first = int(named[0]) if len(named) else 0
            row = (shard, seq, len(held), int(ends[-1]), width, b"".join(held), ef_encode(ends), ef_encode(named.astype(np.uint64) - np.int64(first).astype(np.uint64)), first, len(owners) - len(named))
            return pd.DataFrame([row], columns=[c.split()[0] for c in _SEGMENT.split(", ")])

        for b in batches:
            missing = b["doc_id"].isna().tolist()
            for doc_id, null, ids in zip(b["doc_id"].fillna(0).astype("int64").tolist(), missing, encoder.encode(b["text"]), strict=True):
                held.append(ids + last)
                owners.append(None if null else doc_id)
                size += len(ids) // width + 1
                if size >= segment_ids:
                    yield segment()
                    held, owners, size, seq = [], [], 0, seq + 1
        if held:
            yield segment()

    ordered.mapInPandas(run, _SEGMENT).write.parquet(path)


def read_segments(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the segments alone."""
    seg = spark.read.parquet(path)
    sizes = seg.select("shard", "seq", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard: small enough for one task
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    inside = sizes.select("shard", "seq", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    starts = inside.join(first, "shard").select("shard", "seq", (F.col("first") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b.itertuples(index=False):
                ids = np.frombuffer(s.ids, np.uint16 if s.width == 2 else np.uint32)
                ends, names = EliasFano(s.ends), EliasFano(s.doc_ids)
                for at in range(0, s.n_docs, 1 << 14):
                    i = np.arange(at, min(s.n_docs, at + (1 << 14)))
                    end = ends.select(i)
                    begin = np.concatenate(([0], end[:-1])) if at == 0 else ends.select(i - 1)
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                    named = i >= s.n_null
                    owner = pd.array(np.zeros(len(i), np.int64), dtype="Int64")
                    owner[named] = names.select(i[named] - s.n_null) + s.first_id
                    owner[~named] = pd.NA
                    yield pd.DataFrame({"doc_id": owner, "shard": s.shard, "seq": s.seq, "begin": begin, "n_tokens": end - begin, "ids_crc32": crc})

    rows = seg.select("shard", "seq", "n_docs", "width", "ids", "ends", "doc_ids", "first_id", "n_null").mapInPandas(run, "doc_id long, shard int, seq int, begin long, n_tokens long, ids_crc32 long")
    # a row for each segment: it is broadcast only while Spark measures it as small
    return rows.join(starts, ["shard", "seq"]).select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes docs as segments in the shared folder, reads them back, and returns read_segments().

    Null and empty texts are documents of the end id alone. An empty table gives no rows. Columns but doc_id and text
    are ignored.
    """
    path = scratch(docs.sparkSession, "tokens")
    write_segments(docs, vocabulary, end_id, path)
    return read_segments(docs.sparkSession, path)
