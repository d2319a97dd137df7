"""Ranked lexical search: an inverted index in segments, searched best-first by range maxima of the terms' impacts.

The index is two tables. Documents are cut into segments of a bounded size; postings has a row for each segment and term,
segments one row for each segment. A search joins the postings with the terms of its items, so that each posting list
arrives once with the items that ask for it, and a task goes through its segments one after the other:

* Over a segment's posting lists lies a sparse table of positions of maximal impact (powers of two), so the largest impact
  of a term in any interval of documents is one look-up of two entries.
* An interval's bound is the sum of its terms' maxima. The best intervals are taken first, split at the document of the
  largest term impact, which is scored exactly, and their halves are bounded in turn; short ones are scored as a whole.
* An interval below the tenth score so far, of this segment or the task's earlier ones, cannot hold a result and goes.

Each task emits at most k rows an item; their best k are the result. Scores are whole numbers, so nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: A segment ends with so many documents or bytes of text, and one pass searches for so many items.
SEGMENT_DOCS, SEGMENT_BYTES, ITEMS = 8192, 24 << 20, 1024
#: Intervals taken at once, and the number of documents up to which one is scored as a whole.
AT_ONCE, WHOLE = 64, 16

INDEX = "segment long, term binary, df long, docs array<long>, tfs array<long>"
FOUND = "item_id long, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).max
# What is not in a term becomes a space, A-Z become a-z, bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in runs of about a megabyte."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + (1 << 20))
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def terms(column: Column) -> Column:
    """The terms of a text as an array."""
    folded = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


class _Codes(dict):
    """Numbers of terms in the order of their first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Segment:
    """Documents gathered for one segment."""

    def __init__(self):
        self.codes, self.ids, self.parts, self.counts, self.bytes = _Codes(), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        number, n = self.codes.__getitem__, 0
        for run in terms_of(text):
            self.parts.append(np.fromiter(map(number, run), np.int64, len(run)))
            n += len(run)
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.counts.append(n)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.bytes >= SEGMENT_BYTES

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """A row of INDEX for each term, then one without a term: the documents' ids and lengths."""
        ids, counts = np.array(self.ids, np.int64), np.array(self.counts, np.int64)
        codes = np.concatenate([np.empty(0, np.int64), *self.parts])
        # documents with much the same words stand together: by their commonest term, then by length
        of = np.repeat(np.arange(len(ids)), counts)
        head = self._head(codes, of, len(ids))
        order = np.lexsort((ids, counts, head))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        key, tf = np.unique(codes * len(ids) + place[of], return_counts=True)
        term, doc = np.divmod(key, max(1, len(ids)))
        edges = np.searchsorted(term, np.arange(len(self.codes) + 1))
        words = list(self.codes)
        for a in range(0, len(words), 50_000):
            b = min(len(words), a + 50_000)
            lo, hi, offsets = edges[a], edges[b], pa.array((edges[a : b + 1] - edges[a]).astype(np.int32))
            docs, tfs = (pa.ListArray.from_arrays(offsets, pa.array(x[lo:hi].astype(np.int64))) for x in (doc, tf))
            yield _batch(np.full(b - a, segment), pa.array(words[a:b], pa.binary()), np.diff(edges[a : b + 1]), docs, tfs)
        one = lambda x: pa.array([x[order]], pa.list_(pa.int64()))
        yield _batch(np.array([segment]), pa.array([None], pa.binary()), np.array([len(ids)]), one(ids), one(counts))

    @staticmethod
    def _head(codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        key, count = np.unique(of * (codes.max(initial=0) + 1) + codes, return_counts=True)
        doc, code = np.divmod(key, codes.max(initial=0) + 1)
        best = np.lexsort((code, -count, doc))
        first = best[np.unique(doc[best], return_index=True)[1]]
        head = np.full(n, -1)
        head[doc[first]] = code[first]
        return head


def _batch(segment: np.ndarray, term: pa.Array, df: np.ndarray, docs: pa.Array, tfs: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(segment, pa.int64()), term, pa.array(df, pa.int64()), docs, tfs], ["segment", "term", "df", "docs", "tfs"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at, now = TaskContext.get().partitionId() << 32, _Segment()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            now.add(doc_id, text.as_py() or b"")
            if now.full():
                yield from now.rows(at)
                at, now = at + 1, _Segment()
    if now.ids:
        yield from now.rows(at)


def index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(postings, segments) of every row of docs, (segment, term, df, docs, tfs) and (segment, doc_ids, lengths).

    A row with a null or empty text is a document without terms; repeated rows are documents of their own.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    made = scratch.written(d.mapInArrow(_segments, INDEX), "search-index")
    segments = made.where("term IS NULL").select("segment", F.col("docs").alias("doc_ids"), F.col("tfs").alias("lengths"))
    return made.where("term IS NOT NULL"), segments


def statistics(segments: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""
    counts = segments.select(
        F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l")
    )
    r = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    return r[0], r[1]


def _range_best(values: np.ndarray, longest: int, better) -> np.ndarray:
    """Row j: where the best of the 2^j values from each place on stands, for ranges of up to longest values."""
    best = np.arange(len(values), dtype=np.int32)
    levels = [best]
    for j in range(1, longest.bit_length()):
        half = 1 << (j - 1)
        a, b = best[:-half], best[half:]
        best = best.copy()
        best[: len(a)] = np.where(better(values[b], values[a]), b, a)
        levels.append(best)
    return np.stack(levels)


class _Lists:
    """A segment's posting lists of the terms asked for, one after the other, and their sparse table.

    Ranges across two lists are in the table too, but never asked for.
    """

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray], doc_ids: np.ndarray):
        self.doc_ids, n_docs = doc_ids, len(doc_ids)
        self.first_id = _range_best(doc_ids, n_docs, np.less)
        sizes = np.array([len(d) for d in docs], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.concatenate([np.empty(0, np.int64), *docs])
        self.impact = np.concatenate([np.empty(0, np.int64), *impacts])
        self.stride = n_docs + 1
        self.key = np.repeat(np.arange(len(docs)) * self.stride, sizes) + self.doc
        self.table = _range_best(self.impact, int(sizes.max(initial=1)), np.greater)
        self.log = np.frexp(np.arange(1, max(n_docs, int(sizes.max(initial=1))) + 2).astype(np.float64))[1] - 1

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of the largest impact in [a, b), element by element; none is empty."""
        j = self.log[b - a - 1]
        x, y = self.table[j, a], self.table[j, b - (1 << j)]
        return np.where(self.impact[y] > self.impact[x], y, x)

    def least_id(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest doc_id of [lo, hi), element by element; none is empty."""
        j = self.log[hi - lo - 1]
        return np.minimum(self.doc_ids[self.first_id[j, lo]], self.doc_ids[self.first_id[j, hi - (1 << j)]])

    def at_or_after(self, lists: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first position of each list with that document or a later one."""
        return np.searchsorted(self.key, lists * self.stride + doc)


class _Best:
    """The k best (score, doc_id) of an item: high scores first, equal ones by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score[score > 0]]), np.concatenate([self.ids, ids[score > 0]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]

    def wants(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether documents of at most that score and at least that id can still enter."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (least_id < self.ids[-1]))


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [a, b), and the range that each is of."""
    n = b - a
    of = np.repeat(np.arange(len(a)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + a[of], of


class _Ranges:
    """Intervals of documents, each with the parts of its terms' lists that fall in it; parts of one interval stand together."""

    def __init__(self, lo, hi, of, lists, a, b):
        self.lo, self.hi, self.of, self.lists, self.a, self.b = lo, hi, of, lists, a, b

    def take(self, pick: np.ndarray) -> _Ranges:
        """Those intervals, in ascending order of pick."""
        new = np.full(len(self.lo), -1)
        new[pick] = np.arange(len(pick))
        keep = new[self.of] >= 0
        return _Ranges(self.lo[pick], self.hi[pick], new[self.of[keep]], self.lists[keep], self.a[keep], self.b[keep])

    def plus(self, other: _Ranges) -> _Ranges:
        join = lambda x, y: np.concatenate([x, y])
        return _Ranges(
            join(self.lo, other.lo), join(self.hi, other.hi), join(self.of, other.of + len(self.lo)),
            join(self.lists, other.lists), join(self.a, other.a), join(self.b, other.b),
        )


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each interval, in whole numbers."""
    out = np.zeros(n, np.int64)
    if len(of):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.add.reduceat(values, first)
    return out


def search_segment(lists: _Lists, asked: np.ndarray, weight: np.ndarray, best: _Best) -> int:
    """Puts the segment's documents that belong among an item's best into best; returns how many intervals were taken.

    asked are the item's lists in ascending order, weight each one's weight times its repeats.
    """
    by_list = np.zeros(len(lists.start), np.int64)
    by_list[asked] = weight
    doc_ids, n = lists.doc_ids, len(asked)
    new = _Ranges(np.zeros(1, np.int64), np.full(1, len(doc_ids)), np.zeros(n, np.int64), asked, lists.start[asked], lists.start[asked + 1])
    held, bounds, splits, taken = None, None, None, 0
    while True:
        # bound the new intervals, score short ones as a whole, keep the rest
        new = new.take(np.flatnonzero(new.hi > new.lo))
        m = len(new.lo)
        top = lists.maxima(new.a, new.b)
        value = lists.impact[top] * by_list[new.lists]
        bound = _sums(new.of, value, m)
        want = best.wants(bound, lists.least_id(new.lo, new.hi))
        short = want & (new.hi - new.lo <= WHOLE)
        if short.any():
            s = new.take(np.flatnonzero(short))
            p, of = _spread(s.a, s.b)
            doc = lists.doc[p]
            order = np.argsort(doc, kind="stable")
            doc, score = doc[order], (lists.impact[p] * by_list[s.lists[of]])[order]
            if len(doc):
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                best.add(np.add.reduceat(score, first), doc_ids[doc[first]])
            taken += len(s.lo)
        # an interval is split at the document of its largest single term impact
        long = want & ~short
        if long.any():
            order = np.lexsort((value, new.of))
            last = np.flatnonzero(np.r_[new.of[order][1:] != new.of[order][:-1], True])
            split = np.full(m, -1)
            split[new.of[order][last]] = lists.doc[top[order][last]]
            pick = np.flatnonzero(long)
            part = new.take(pick)
            if held is None:
                held, bounds, splits = part, bound[pick], split[pick]
            else:
                held, bounds, splits = held.plus(part), np.concatenate([bounds, bound[pick]]), np.concatenate([splits, split[pick]])
        if held is None:
            return taken
        keep = np.flatnonzero(best.wants(bounds, lists.least_id(held.lo, held.hi)))
        if not len(keep):
            return taken
        # the best intervals first
        order = keep[np.lexsort((held.lo[keep], -bounds[keep]))]
        now, later = np.sort(order[:AT_ONCE]), np.sort(order[AT_ONCE:])
        r, at = held.take(now), splits[now]
        held, bounds, splits = (held.take(later), bounds[later], splits[later]) if len(later) else (None, None, None)
        taken += len(now)
        p = lists.at_or_after(r.lists, at[r.of])
        inside = p < r.b
        hit = np.zeros(len(p), bool)
        hit[inside] = lists.doc[p[inside]] == at[r.of[inside]]
        best.add(_sums(r.of[hit], lists.impact[p[hit]] * by_list[r.lists[hit]], len(now)), doc_ids[at])
        left, right = p > r.a, p + hit < r.b
        new = _Ranges(
            np.concatenate([r.lo, at + 1]), np.concatenate([at, r.hi]), np.concatenate([r.of[left], r.of[right] + len(now)]),
            np.concatenate([r.lists[left], r.lists[right]]), np.concatenate([r.a[left], (p + hit)[right]]), np.concatenate([p[left], r.b[right]]),
        )


def _searcher(k: int, n_all: int, l_all: int):
    """Goes through sorted rows (segment, block, term, docs, tfs, weight, items, repeats), a segment's own row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        held: list = []
        ids = penalty = key = None

        def finish() -> None:
            if not held:
                return
            lists = _Lists([h[0] for h in held], [h[1] for h in held], ids)
            asked: dict = {}
            for at, (_, _, weight, items, repeats) in enumerate(held):
                for item, r in zip(items, repeats, strict=True):
                    asked.setdefault(item, []).append((at, weight * r))
            for item, wanted in asked.items():
                at, weight = np.array(wanted, np.int64).T
                search_segment(lists, at, weight, best.setdefault(item, _Best(k)))
            held.clear()

        for batch in batches:
            seg, block, weights = (batch.column(c).to_pylist() for c in ("segment", "block", "weight"))
            docs, tfs = batch.column("docs"), batch.column("tfs")
            for i, now in enumerate(zip(seg, block, strict=True)):
                d, t = docs[i].values.to_numpy(), tfs[i].values.to_numpy()
                if now != key:
                    finish()
                    key, ids = now, d
                    penalty = 8 * (100 - 75 + 75 * t * n_all // max(1, l_all))
                    continue
                held.append((d, 1_000_000_000 * t // (1000 * t + penalty[d]), weights[i], batch.column("items")[i].as_py(), batch.column("repeats")[i].as_py()))
        finish()
        rows = [(item, None if i == _NO_ID else int(i), int(s)) for item, b in best.items() for s, i in zip(b.score, b.ids, strict=True)]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

    return run


def search(postings: DataFrame, segments: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of the highest score above 0, ties by doc_id.

    items has (item_id, text). Rows of one item_id are one item, with the last of their texts in byte order; a null id is
    an item too. An item without known terms has no rows. Documents without a doc_id come after all others of their score.
    """
    scratch, kept = Scratch(items.sparkSession), Scratch(items.sparkSession)
    n_all, l_all = statistics(segments)
    asked = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max("text").alias("text"))
    blocks = max(1, -(-asked.count() // ITEMS))
    words = asked.select("item_id", F.explode(terms(F.col("text"))).alias("word")).groupBy("item_id", "word").agg(F.count("*").alias("r"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    words = words.groupBy(F.encode("word", "UTF-8").alias("term"), block.alias("block")).agg(F.collect_list(F.struct("item_id", "r")).alias("x"))
    words = scratch.written(words.select("term", "block", F.col("x.item_id").alias("items"), F.col("x.r").alias("repeats")), "search-terms")
    df = postings.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_all) + 2) / (2 * F.col("df") + 1))).cast("long")
    words = scratch.written(words.join(df.select("term", weight.alias("weight")), "term"), "search-weights")
    rows = postings.join(words, "term").select("segment", "block", "term", "docs", "tfs", "weight", "items", "repeats")
    own = segments.select(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("binary").alias("term"), F.col("doc_ids").alias("docs"),
        F.col("lengths").alias("tfs"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("items"), F.lit(None).cast("array<long>").alias("repeats"),
    )
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.unionByName(own).repartition(n, "segment", "block").sortWithinPartitions("segment", "block", "term")
    found = kept.written(rows.mapInArrow(_searcher(k, n_all, l_all), FOUND), "search-found")
    scratch.clear()
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, numbered from 1."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search over an index of every row and whole text of docs (doc_id, text); other columns are ignored."""
    scratch = Scratch(docs.sparkSession)
    postings, segments = index(docs, scratch)
    found = search(postings, segments, items, k)
    scratch.clear()
    return found
