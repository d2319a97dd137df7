"""Near-duplicates by BagMinHash: signatures of weighted Jaccard similarity, banding, and a check of the texts themselves.

A text is the multiset of its five-word shingles (a shorter text: of all its words as one shingle). For each shingle a
Poisson process runs over its weight, which is cut into dyadic blocks [0,1), [1,2), [2,4) ...; each block's process
yields points in ascending time, each with a signature component and a height in the block, and a point counts if its
height is below the weight. A component keeps its earliest point. Two texts agree in a component with a probability of
exactly their weighted Jaccard similarity. Points come in ascending order, so a shingle's process ends as soon as it is
later than every component's earliest point.

Equal texts are one node. Nodes that share a band are a bucket; each is compared with one of them, the bucket's leader,
which is the node that meets most others over all its buckets: one comparison a row of a bucket. Buckets that these
links don't join into one component go on. In those of up to SMALL nodes, nodes of different components are compared.
The nodes of larger ones are joined exactly, whatever the size, by their rarest shingles: if two texts have enough in
common to be similar, the first shingle that they share, in the order of how many texts have it, comes so early in both
that enough weight follows it. Texts that differ from most of a group's others have shingles of their own first, so they
meet few. Comparisons inside a component would tell nothing new. What a comparison says rests on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, whole_text, with_group

BANDS, ROWS = 26, 5
SMALL = 16
#: Members that are compared with one text in a task; a text with more of them goes to several tasks.
CHUNK = 256
_M = BANDS * ROWS
_U = np.uint64
#: Characters of texts that are worked on at once.
_PORTION = 1 << 19
#: Points drawn for each shingle in each step; the same for every text, so that sums of waiting times agree to the bit.
_STEPS = [1, 1, 1, 1, 2, 2, 4, 4, 8, 8, 16, 16, 32]
_ODD = _U(0x9E3779B97F4A7C15)
_ODD_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=_U)
_IS_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE_SPACE = regex.compile("[" + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers_of_odd(n: int) -> list[np.ndarray]:
    """The first n powers, at least, of an odd number and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_ODD, _ODD_INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and where it begins: polynomials in the bytes' random values, from their running sums."""
    b = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers_of_odd(len(b) + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[b] * up[: len(b)])))
    return _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U)), begin


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text."""
    raw = [(" ".join(t.split()) if not t.isascii() and _WIDE_SPACE.search(t) else t).encode("utf-8", "surrogatepass") for t in texts]
    if sum(map(len, raw)) <= 4 * _PORTION:
        h, begin = _word_hashes(b"\n".join(raw))
        ends = np.cumsum([len(r) + 1 for r in raw])
        return h, np.diff(np.searchsorted(begin, ends), prepend=0)
    out, counts = [], []
    for r in raw:  # a long text goes in portions that end with a space
        n = at = 0
        while at < len(r):
            cut = len(r) if len(r) - at <= 4 * _PORTION else max((r.rfind(c, at, at + 4 * _PORTION) for c in (b" ", b"\n")), default=-1)
            cut = len(r) if cut <= at else cut
            out.append(_word_hashes(r[at:cut])[0])
            n, at = n + len(out[-1]), cut + 1
        counts.append(n)
    return np.concatenate(out) if out else np.zeros(0, _U), np.array(counts, np.int64)


def shingle_table(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, how often, text) of the distinct shingles of each text, ascending in each; nothing for a text without words."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    stop = np.cumsum(count)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) + (first - stop + count)[text]
    out = np.zeros(len(text), _U)
    last = (first + n - 1)[text] if (n < size).any() else None
    for i in range(size):
        if last is None:
            out = _mix(out * _ODD + h[at + i])
        else:
            out = np.where(at + i <= last, _mix(out * _ODD + h[np.minimum(at + i, last)]), out)
    for b, e in zip((stop - count).tolist(), stop.tolist(), strict=True):
        out[b:e].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return out[begin], np.diff(begin, append=len(out)), text[begin]


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's shingles, ascending, and how often each occurs."""
    return shingle_table([text])[:2]


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets with ascending keys."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def signature_table(keys: np.ndarray, weights: np.ndarray, text: np.ndarray, n: int, m: int = _M) -> np.ndarray:
    """The earliest time of each component of n texts; equal times are the same point. Infinite for texts without keys."""
    best = np.full(n * m, np.inf)
    parts, block, low, size = [], 0, 0, 1
    while (on := weights > low).any():
        streams = _mix(keys[on] + _U((0xA0761D6478BD642F * (block + 1)) & (2**64 - 1)))
        parts.append((streams, text[on], weights[on], np.full(len(streams), low), np.full(len(streams), size)))
        block, low = block + 1, low + size
        size = low
    for at in range(0, max((len(p[0]) for p in parts), default=0), 1 << 18):
        stream, owner, top, low_, rate = (np.concatenate(c) for c in zip(*(tuple(x[at : at + (1 << 18)] for x in p) for p in parts), strict=True))
        time, done, turn = np.zeros(len(stream)), 0, 0
        while len(stream):
            step = _STEPS[min(turn, len(_STEPS) - 1)]
            a = _mix(stream[:, None] + np.arange(done, done + step, dtype=_U) * _U(0xD1342543DE82EF95))
            wait = -np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            t = time[:, None] + np.cumsum(wait / (rate[:, None] * m), axis=1)
            b = _mix(a ^ _U(0x8EBC6AF09C88C6E3))
            slot = owner[:, None] * m + (b % _U(m)).astype(np.int64)
            counts = low_[:, None] + rate[:, None] * ((b >> _U(11)).astype(np.float64) * 2.0**-53) < top[:, None]
            np.minimum.at(best, slot[counts], t[counts])
            time, done, turn = t[:, -1], done + step, turn + 1
            go = time < best.reshape(n, m).max(1)[owner]
            stream, owner, top, low_, rate, time = stream[go], owner[go], top[go], low_[go], rate[go], time[go]
    return best.reshape(n, m)


def portions(texts: list[str]) -> Iterator[slice]:
    """Slices of the list with about _PORTION characters each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _PORTION:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def bands(texts: list[str]) -> list[np.ndarray]:
    """A 64-bit hash of each band of each text's signature; none for a text without words."""
    out: list[np.ndarray] = []
    for some in portions(texts):
        part = texts[some]
        keys, weights, text = shingle_table(part)
        bits = signature_table(keys, weights, text, len(part)).view(_U).reshape(len(part), BANDS, ROWS)
        h = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(part), BANDS))
        for i in range(ROWS):
            h = _mix(h * _ODD + bits[:, :, i])
        worded = np.bincount(text, minlength=len(part)) > 0
        out += [row if w else row[:0] for row, w in zip(h.view(np.int64), worded, strict=True)]
    return out


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float, tables: Scratch) -> DataFrame:
    """Those pairs (a, b) of nodes that are similar by the multisets of their whole texts, written.

    The nodes compared with one a are dealt to chunks, and each chunk gets the text of a once.
    """
    pairs = tables.written(pairs, "pairs")
    dealt = with_group(pairs, ["a"], [F.count("*").alias("n")], "b").withColumn("chunk", F.expr(f"pmod(xxhash64(b), (n + {CHUNK - 1}) div {CHUNK})")).select("a", "chunk", "b")
    dealt = tables.written(dealt, "chunks")
    one, many = dealt.select("a", "chunk").distinct(), dealt
    one = one.join(texts.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("binary").alias("b"), "text")
    many = many.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "text")
    rows = one.unionByName(many).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in batches:
            a, b, texts_ = p["a"].tolist(), p["b"].tolist(), p["text"].tolist()
            out = []
            for some in portions(texts_):
                keys, weights, text = shingle_table(texts_[some])
                ends = np.searchsorted(text, np.arange(some.stop - some.start + 1)).tolist()
                for i, (x, y) in enumerate(zip(ends, ends[1:]), some.start):
                    this = keys[x:y], weights[x:y]
                    if b[i] is None:
                        held = this
                    elif similarity(held, this) >= threshold:
                        out.append((a[i], b[i]))
            yield pd.DataFrame(out, columns=["a", "b"])

    return tables.written(rows.mapInPandas(run, "a binary, b binary"), "similar")


def _by_rare_shingles(hits: DataFrame, texts: DataFrame, threshold: float, tables: Scratch) -> DataFrame:
    """Pairs (a, b) among the nodes of hits (key, node, root, n), of different roots, that may be similar: all that are.

    hits: the rows of large buckets, written. A node is looked up unless it is in the most frequent component of each of
    its buckets, since of two components one is not.
    """
    least = f"{threshold} / (1 + {threshold})"  # of both texts' weights, what similar texts have in common

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for some in portions(p["text"].tolist()):
                keys, weights, text = shingle_table(p["text"][some].tolist())
                total = np.bincount(text, weights).astype(np.int64)
                yield pd.DataFrame({"shingle": keys.view(np.int64), "node": p["node"].to_numpy()[some][text], "weight": weights, "total": total[text]})

    nodes = hits.select("node").distinct()
    table = tables.written(texts.join(nodes, "node", "left_semi").mapInPandas(run, "shingle long, node binary, weight long, total long"), "shingles")
    sizes = table.select("node", "total").distinct()
    roots = hits.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
    of = hits.join(sizes, "node").join(roots, "key").select("key", "node", "root", "total", (F.col("root") != F.col("main")).alias("asks"))
    of = tables.written(of, "large-buckets")
    # no partner of a node weighs less than the lightest node of its buckets
    about = with_group(of, ["key"], [F.min("total").alias("lightest")], "node").groupBy("node").agg(F.first("root").alias("root"), F.max("asks").alias("asks"), F.min("lightest").alias("lightest"))
    # shingles that one node alone has come first in the order; they lead to no partner and only take weight
    shared = with_group(table, ["shingle"], [F.count("*").alias("texts")], "node", having="texts > 1")
    w = Window.partitionBy("node")
    before = F.sum("weight").over(w.orderBy("texts", "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = shared.withColumn("after", F.sum("weight").over(w) - before + F.col("weight"))
    early = shared.join(about, "node").where(f"after >= {least} * (total + greatest(lightest, {threshold} * total)) - 1e-6")
    early = tables.written(early.select("shingle", "node", "root", "asks", "total", "after"), "early-shingles")
    x, y = (early.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "asks", "total", "after")]) for s in "xy")
    enough = f"least(after_x, after_y) >= {least} * (total_x + total_y) - 1e-6"
    met = x.where("asks_x").join(y, "shingle").where(f"root_x <> root_y AND (NOT asks_y OR node_x < node_y) AND {enough}")
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _components_of(keys: DataFrame, texts: DataFrame, threshold: float, tables: Scratch) -> DataFrame:
    """(node, root) of nodes that are connected with others. keys: (key, node, n), the rows of all buckets, written."""
    # a node's popularity is how many rows it meets; the same node leads all buckets that it is the most popular of
    popular = keys.groupBy("node").agg(F.sum("n").alias("popularity"))
    ranked = tables.written(keys.join(popular, "node"), "ranked")
    led = with_group(ranked.select("key", "node", "popularity"), ["key"], [F.max(F.struct("popularity", "node")).alias("leader")], "node")
    stars = led.select(F.col("leader.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    links = _similar(stars, texts, threshold, tables)
    roots = components(links, tables)

    hits = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hits = tables.written(hits, "rooted")
    # buckets that lie in one component have nothing more to tell
    hits = tables.written(with_group(hits, ["key"], [F.min("root").alias("lo"), F.max("root").alias("hi")], "node", having="lo <> hi").drop("lo", "hi"), "leftovers")
    x, y = (hits.where(f"n <= {SMALL}").select("key", F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    few = x.join(y, "key").where("a < b AND ra <> rb").select("a", "b").distinct()
    large = tables.written(hits.where(f"n > {SMALL}"), "large")
    rest = few.unionByName(_by_rare_shingles(large, texts, threshold, tables)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _similar(rest, texts, threshold, tables)
    return components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b").unionByName(more), tables)


def components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars until nothing changes."""
    edges = tables.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = tables.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        large = with_group(both, ["a"], [F.min("b").alias("least")], "b").withColumn("m", F.least("a", "least"))
        large = tables.written(large.where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "large-star")
        # small star: each node's lesser neighbours and itself go to the least of them
        lesser = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = with_group(lesser, ["u"], [F.min("v").alias("m")], "v")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        small = tables.written(small, "small-star")
        change = lambda d: d.select(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if change(small) == change(edges):
            return small.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = small


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, class_size) for every row of docs, written.

    A class is a connected component of texts whose five-word shingles have a weighted Jaccard similarity of at least
    threshold; class_id is the least doc_id in it, class_size its number of rows. Equal texts are in one class, null
    and empty ones among each other, too; a text without words is like no other text. Repeated rows are members each.
    Rows with a null doc_id are members but name a class only if all do so (then it is null). Other columns are ignored.
    """
    tables = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("node", F.unhex(F.md5("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "node": b["node"], "bands": bands(b["text"].tolist())})

    rows = tables.written(d.mapInPandas(run, "doc_id long, node binary, bands array<long>"), "signatures")
    nodes = rows.groupBy("node").agg(F.first("bands").alias("bands"))
    keys = tables.written(nodes.select(F.explode("bands").alias("key"), "node"), "bands")
    keys = tables.written(with_group(keys, ["key"], [F.count("*").alias("n")], "node", having="n > 1"), "shared-bands")
    texts = tables.written(d.join(keys.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    roots = _components_of(keys, texts, threshold, tables)

    salts = 32
    rows = rows.select("doc_id", "node", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    each = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    each = tables.written(each.join(roots, "node", "left").select("node", "first", "n", "mask", F.coalesce("root", "node").alias("root")), "members")
    named = with_group(each, ["root"], [F.min("first").alias("class_id"), F.sum("n").alias("class_size")], "node")
    named = named.select("node", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), b -> (shiftright(mask, b) & 1L) = 1L)")).alias("salt"), "class_id", "class_size")
    out = Scratch(docs.sparkSession).written(rows.join(named, ["node", "salt"]).select("doc_id", "class_id", "class_size"), "classes")
    tables.clear()
    return out
