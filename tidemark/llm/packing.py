"""Packing documents into fixed-length sequences by patterns fitted to the length histogram.

Only the histogram of piece lengths is planned on, which has at most max_len entries however many documents there are.
Patterns of one to five pieces that fill a sequence exactly are enumerated: one length, two, or two and up to three pieces
of a third. Non-negative least squares fits how often each is repeated so that the patterns' lengths come near the
histogram (multiplicative steps, which keep counts positive): once over all patterns, to choose a few for each length, then
in earnest over those. Counts are rounded, largest first, as far as there are pieces; what remains is fitted again and at
last packed best fit, longest first, a whole run of equal lengths at a time. The plan has a few rows a length however many
pieces there are; a piece finds its place by its rank among those of its length with a binary search in the plan, so no
task holds more than its own rows. The table of patterns takes about a quarter of max_len squared rows on the driver.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import whole_text, written
from ._tokens import library_encoder

#: Fits of what the ones before left, how many of the last repeat patterns as often as they can, and the share of the
#: squares that a step must gain.
ROUNDS, AS_THEY_COME, TOLERANCE = 10, 5, 1e-3
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


#: Pieces of a pattern at most.
_MOST = 5


def patterns(lengths: list[int], max_len: int) -> np.ndarray:
    """Multisets of the given lengths with sum max_len, a row each, padded with 0."""
    there = np.zeros(max_len + 1, bool)
    there[lengths] = True
    desc = np.array(sorted(set(lengths), reverse=True))
    kind = np.int16 if max_len < 1 << 15 else np.int32
    out = [np.array([[max_len] + [0] * (_MOST - 1)], kind)] if there[max_len] else []
    for i in desc.tolist():
        rest = max_len - i
        if 0 < rest <= i and there[rest]:
            out.append(np.array([[i, rest] + [0] * (_MOST - 2)], kind))
        j = desc[(desc <= i) & (desc < rest)]
        for n in range(1, _MOST - 1):
            k, odd = np.divmod(rest - j, n)
            ok = (odd == 0) & (k <= j)
            ok &= there[np.where(ok, k, 0)]
            row = np.zeros((int(ok.sum()), _MOST), kind)
            row[:, 0], row[:, 1], row[:, 2 : 2 + n] = i, j[ok], k[ok][:, None]
            out.append(row)
    return np.concatenate(out) if out else np.zeros((0, _MOST), kind)


def _steps(found: np.ndarray, wanted: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Least squares with x >= 0 by multiplicative steps, until a step gains less than TOLERANCE of the squares, or most."""

    def over(values: np.ndarray) -> np.ndarray:
        """The sum of values over each pattern's pieces."""
        return sum(values[found[:, c]] for c in range(_MOST))

    target, squares = over(wanted), math.inf
    for _ in range(most):
        made = np.bincount(found[:, 0], x, len(wanted))
        for c in range(1, _MOST):
            made += np.bincount(found[:, c], x, len(wanted))
        made[0] = 0
        now = float(((made - wanted)[1:] ** 2).sum())
        if now > squares * (1 - TOLERANCE):
            break
        squares = now
        x = x * target / np.maximum(over(made), 1e-12)
    return x


def _support(found: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The patterns that are the most repeated ones of some length: at most _MOST for each length."""
    order = np.argsort(-x, kind="stable")
    first = [order[np.unique(found[order, c], return_index=True)[1]] for c in range(_MOST)]
    return np.unique(np.concatenate(first))


def fit(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Repeat counts of patterns: least squares against the histogram with x >= 0, rounded, never beyond what is there.

    A first fit over all patterns chooses those that are fitted in earnest, at most _MOST for each length; so counts grow
    with the histogram while their number doesn't. What rounding leaves is fitted again; in the last rounds each
    pattern is repeated as often as there are pieces.
    """
    found = patterns(list(histogram), max_len)
    there = np.zeros(max_len + 1, np.int64)
    there[list(histogram)] = list(histogram.values())
    out: dict[tuple[int, ...], int] = {}
    for turn in range(ROUNDS):
        there[0] = 1  # padding is never short
        found = found[np.logical_and.reduce([there[found[:, c]] > 0 for c in range(_MOST)])]
        if not len(found):
            break
        wanted = there.astype(float)
        wanted[0] = 0
        some = found[_support(found, _steps(found, wanted, np.full(len(found), 1e-3), 10))]
        x = _steps(some, wanted, np.full(len(some), 1.0), 200)
        there[0] = 1 << 62
        for p in np.argsort(-x, kind="stable").tolist():
            lengths = tuple(k for k in some[p].tolist() if k)
            most = min(int(there[k]) // lengths.count(k) for k in lengths)
            n = most if turn >= ROUNDS - AS_THEY_COME else min(round(x[p]), most)
            if n > 0:
                out[lengths] = out.get(lengths, 0) + n
                for k in lengths:
                    there[k] -= n
    return list(out.items())


def best_fit(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for runs of equal lengths: (lengths of a sequence, how many such)."""
    room: dict[int, list[list]] = {}
    keys: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], n: int, free: int) -> None:
        if free == 0:
            done.append((lengths, n))
        elif free in room:
            room[free].append([lengths, n])
        else:
            room[free] = [[lengths, n]]
            bisect.insort(keys, free)

    for k in sorted(histogram, reverse=True):
        n = histogram[k]
        while n > 0:
            at = bisect.bisect_left(keys, k)
            if at < len(keys):
                free = keys[at]
                lengths, m = room[free].pop()
                if not room[free]:
                    del room[free], keys[at]
                used = min(m, n)
                if m > used:
                    put(lengths, m - used, free)
                put((*lengths, k), used, free - k)
                n -= used
            else:
                each = max_len // k
                if n >= each:
                    put((k,) * each, n // each, max_len - each * k)
                    n %= each
                else:
                    put((k,) * n, 1, max_len - n * k)
                    n = 0
    return done + [(lengths, n) for groups in room.values() for lengths, n in groups]


def plan(histogram: dict[int, int], max_len: int) -> pd.DataFrame:
    """(length, lo, hi, sequence, offset), sorted: of a length's pieces, those with ranks lo <= r < hi go to sequence + r - lo."""
    fitted = fit(histogram, max_len)
    rest = dict(histogram)
    for lengths, n in fitted:
        for k in lengths:
            rest[k] -= n
    rows, given, sequence = [], dict.fromkeys(histogram, 0), 0
    for lengths, n in fitted + best_fit({k: n for k, n in rest.items() if n}, max_len):
        offset = 0
        for k in lengths:
            rows.append((k, given[k], given[k] + n, sequence, offset))
            given[k] += n
            offset += k
        sequence += n
    slots = pd.DataFrame(rows, columns=["length", "lo", "hi", "sequence", "offset"]).astype("int64")
    return slots.sort_values(["length", "lo"], ignore_index=True)


class Places:
    """A plan to look ranks up in: a binary search among a length's rows, which follow each other without gaps."""

    def __init__(self, slots: pd.DataFrame):
        self.length, self.lo, self.sequence, self.offset = (slots[c].to_numpy() for c in ("length", "lo", "sequence", "offset"))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        lo, hi = np.searchsorted(self.length, length), np.searchsorted(self.length, length, "right") - 1
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            right = self.lo[mid] <= rank
            lo, hi = np.where(right, mid, lo), np.where(right, hi, np.maximum(lo, mid - 1))
        return self.sequence[lo] + rank - self.lo[lo], self.offset[lo]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, max_len: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): encoded documents cut to max_len.

    nth counts the pieces of the same length in the same task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = library_encoder(vocabulary)
        task = TaskContext.get().partitionId()
        seen = [0] * (max_len + 1)
        end = np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for doc_id, packed in zip(b["doc_id"].array, encoder.encode(b["text"]), strict=True):
                ids = np.concatenate((np.frombuffer(packed, encoder.dtype).astype("<u4"), end))
                for piece, at in enumerate(range(0, len(ids), max_len)):
                    part = ids[at : at + max_len]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECE.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, _PIECE)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, max_len: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Null and empty texts are documents of the end id alone; repeated rows are packed as often as they occur; an empty
    table gives no rows. Columns but doc_id and text are ignored.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, end_id, max_len), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = by_task.groupBy("length").agg(F.sum("n").alias("n"))
    # at most max_len rows, whatever the table's size, and so is the plan that goes to the tasks: see fit and best_fit
    slots = plan({r["length"]: r["n"] for r in totals.collect()}, max_len)
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "task", "nth")
    places = Places(slots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = places.find(b["length"].to_numpy(), b["rank"].to_numpy())
            yield b.drop(columns="rank").assign(doc_id=b["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
