"""URL filter, lexical search and Merkle manifest against DuckDB, brute-force versions and odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import lexical_search, merkle, queries, url_filter
from tidemark.llm._shared import Scratch

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_lexical_search", "op13_merkle_manifest"])
def test_same_rows_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# --- URLs

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Org/x", "https://x.example.org/es/1", "http://example.org/en/1?q", "http://anexample.org/es/", "http://a.com/fr/", "http://a.com/de/#f",
    "http://www.Listed.net:80/a/?b=2&utm_source=x&a=1#t", "https://listed.net/a?a=1&b=2", "http://listed.net/a?b=2", "http://u.net/?://v.org/", "http://ü.net/ß", "http://n.net/" + "x" * 20_000, "http://n.net/\n",
]
PAGES = "page_id long, url string, html string, key string, verdict string, salt int"


def judged(spark, urls, listed, rules=queries.URL_RULES):
    pages = spark.createDataFrame([(i, u, None, "k", "v", 1) for i, u in enumerate(urls)], PAGES)
    return url_filter.judge(pages, spark.createDataFrame([(u,) for u in listed], "url string"), rules)


def test_rules_and_list(spark):
    got = {r["page_id"]: r for r in judged(spark, URLS, ["http://listed.net/a/?a=1&b=2", None, "", "nothing"]).collect()}
    assert len(got) == len(URLS)
    said = [(got[i]["host"], got[i]["path"][:10], got[i]["rule"], got[i]["verdict"]) for i in range(len(URLS))]
    assert said[:4] == [("", "", None, "allow")] * 4
    assert said[4:10] == [
        ("a.org", "/x", "org/", "allow"), ("x.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/1", "example.org/en/1", "block"),
        ("anexample.org", "/es/", "org/", "allow"), ("a.com", "/fr/", "com/fr/", "allow"), ("a.com", "/de/", "com/de/", "block"),
    ]
    assert [s[3] for s in said[10:13]] == ["block", "block", "allow"]
    assert said[13][:2] == ("u.net", "/") and said[14][:2] == ("ü.net", "/ß") and got[16]["path"] == "/\n"
    assert {r["verdict"] for r in judged(spark, URLS, [], []).collect()} == {"allow"}
    assert judged(spark, [], ["http://a.b/c"]).count() == 0


def test_filter_passes_every_listed_url_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("key"))
    blocks = url_filter.blocks_for(20_000)
    bloom = url_filter.bloom_filter(keys, blocks)
    assert bloom.count() <= blocks and url_filter.blocks_for(10**12) == url_filter.MAX_BLOCKS
    assert url_filter.passed(keys, bloom, blocks).where("maybe").count() == 20_000
    others = spark.range(20_000, 60_000).select(F.concat(F.lit("h.net/"), "id").alias("key"))
    assert url_filter.passed(others, bloom, blocks).where("maybe").count() < 400


def test_a_filter_of_one_block_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    urls = [f"http://h.net/{i % 500}" for i in range(2_000)] + ["http://hot.net/"] * 3_000
    listed = {f"http://h.net/{i}" for i in range(0, 500, 3)} | {"http://hot.net/"}
    got = judged(spark, urls, sorted(listed), [])
    assert {r["page_id"]: r["verdict"] == "block" for r in got.collect()} == {i: u in listed for i, u in enumerate(urls)}


# --- search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    """The contract row by row: docs and items are (id, text)."""
    words = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    out = []
    for item, text in items:
        scored = []
        for i, w in words:
            m = 100 - 75 + 75 * sum(w.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in w)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, segment long").repartition(parts)
    got = lexical_search.search_documents(d, spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=repr)


def test_search_against_every_document(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "WHOLE", 2)
    monkeypatch.setattr(lexical_search, "AT_ONCE", 3)
    monkeypatch.setattr(lexical_search, "ITEMS", 7)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(1, 61)[::-1] / 1830))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in rng.permutation(400)]
    docs += [(1000 + i, "w1 w2 w3 w59") for i in range(50)] + [(None, "w59 w59"), (2000, None), (2001, "")]
    items = [(i, text(8)) for i in range(20)] + [(90, "w1 w2 w3 w59"), (91, None), (92, "unknown"), (None, "w59 w59 w1")]
    assert found(spark, docs, items) == ranked(docs, items)
    assert found(spark, docs, items, k=1, parts=1) == ranked(docs, items, 1)


def test_search_of_odd_texts(spark):
    docs = [(1, "É é ß İ 日本 日本 a1"), (1, "É é ß İ 日本 日本 a1"), (2, "A1,a1;A1\x00a1\x7f"), (3, "\n\t"), (4, "wort " * 400_000), (5, "x" * 3_000_000), (6, "nbsp bound")]
    items = [(1, "a1 É 日本"), (2, "WORT"), (3, "nbsp"), (4, "nbsp bound"), (5, "x" * 3_000_000), (5, "")]
    want = ranked(docs, [i for i in items if i[1]])
    assert found(spark, docs, items) == want and len(want) == 6
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_most_intervals_are_never_taken(spark):
    docs = [(i, f"common filler words here {'needle' if i % 997 == 0 else 'hay'} {i % 50}") for i in range(8000)]
    batches = iter(spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.encode("text", "UTF-8").alias("text")).toArrow().to_batches())
    seg = lexical_search._Segment()
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seg.add(i, t)
    rows = {r["term"]: r for b in seg.rows(0) for r in b.to_pylist()}
    lists = [rows[t] for t in (b"common", b"needle", b"hay")]
    held = lexical_search._Lists([np.array(r["docs"]) for r in lists], [np.array(r["tfs"]) * 1000 for r in lists], np.array(rows[None]["docs"]))
    best = lexical_search._Best(5)
    taken = lexical_search.search_segment(held, np.arange(3), np.array([1, 7000, 2]), best)
    assert best.ids.tolist() == [0, 997, 1994, 2991, 3988] and taken < 100


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by building each tree in memory."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, low):
        text = r["text"].translate(LOWER) if low and r["text"] is not None else r["text"]
        return h(field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(r["n_chars"]), field(text))

    def tree(level):
        """The top, and for each node of the level its steps (before, after)."""
        steps, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, a in enumerate(at):
                run = level[a // 16 * 16 : a // 16 * 16 + 16]
                steps[i].append((run[: a % 16], run[a % 16 + 1 :]))
            level, at = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], [a // 16 for a in at]
        return level[0], steps

    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, False), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([own[s][0] for s in names]) if names else (None, [])
    out = []
    for s, up in zip(names, above, strict=True):
        for x, steps in zip(sorted(by[s], key=lambda x: x[:3]), own[s][1], strict=True):
            i = x[3]["doc_id"]
            cur = leaf(x[3], i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
            for before, after in steps + up:
                cur = h(*before, cur, *after)
            out.append((i, x[2], own[s][0], root, h(*[d for b, a in steps + up for d in b + a]), cur, cur == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, digest string"


def manifest(spark, rows):
    d = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "t", 1, "d") for r in rows], DOCS).repartition(3)
    got = merkle.manifest(d).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=repr)


def made(n, source, text="A text", start=0):
    return [{"doc_id": start + i, "text": f"{text} {i}", "lang": "en", "source": source, "n_chars": i} for i in range(n)]


def test_manifest_against_trees_in_memory(spark):
    rows = made(300, "hot") + made(16, "full", start=400) + made(17, "one more", start=500) + made(1, "alone", start=600) + made(3, None, start=700) + made(2, "", start=800)
    rows += [r for i in range(20) for r in made(1, f"s{i}", start=900 + i)]
    rows += [
        {"doc_id": None, "text": "No id", "lang": None, "source": "hot", "n_chars": None}, {"doc_id": 5, "text": None, "lang": "Ü", "source": "hot", "n_chars": 0},
        {"doc_id": 5, "text": "", "lang": "", "source": "hot", "n_chars": None}, rows[7], {"doc_id": 950, "text": "ÄÖ X" * 50_000, "lang": "de", "source": "ü", "n_chars": 1},
    ]
    got = manifest(spark, rows)
    assert got == plain(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_few_rows(spark):
    assert manifest(spark, []) == []
    assert manifest(spark, made(1, "only")) == plain(made(1, "only"))
    assert manifest(spark, made(40, "only")) == plain(made(40, "only"))


def test_siblings_come_in_order(spark):
    nodes = spark.createDataFrame([("t", i, 20, bytes([i])) for i in range(21)], "tree string, idx long, last long, digest binary")
    got = {r["idx"]: [x[0] for x in r["others"]] for r in merkle.with_others(nodes).collect()}
    assert got == {i: [j for j in range(i // 16 * 16, min(21, i // 16 * 16 + 16)) if j != i] for i in range(21)}
    assert Scratch(spark).paths == []
