"""Values of queries and operators that SQL doesn't tell."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import market, quality, technical, warehouse
from tidemark.plans import load  # noqa: F401
from tidemark.plans import registry, views
from tidemark.sources import text

SF = f"{DATA}/sf0.001"


def test_content_hashes(spark):
    rows = [(1, "a", 2.0), (2, None, 1.0), (2, None, 1.0), (3, "b", None)]
    d = spark.createDataFrame(rows, "k int, t string, v double")
    whole = quality.content_hash(d).first()
    assert quality.content_hash(d.repartition(3).select("v", "k", "t")).first() == whole and whole["rows"] == 4
    for other in (rows[:3], [*rows[:3], (3, "b", 0.0)], [*rows[:3], (3, None, None)]):
        assert quality.content_hash(spark.createDataFrame(other, "k int, t string, v double")).first() != whole
    assert quality.content_hash(d.limit(0)).first()["rows"] == 0
    again = [registry.QUERIES[n](spark, SF).collect() for n in ("s18_content_hash", "s18_content_hash")]
    assert again[0] == again[1]


def test_text_of_documents(spark):
    pages = [("<p>café &amp; <b>thé</b></p><script>x<y</script><!-- no -->".encode(),), ("<p>한국어 문서</p>".encode("cp949"),), (b"",), (None,)]
    got = [r["text"] for r in text.doc_text(spark.createDataFrame(pages, "content binary"), "content").collect()]
    assert got[:3] == ["café & thé", "한국어 문서", ""]
    d = spark.createDataFrame([(1, "lead<h1>A</h1>one<h2>B <i>b</i></h2><style>s</style>two"), (2, None)], "id int, html string")
    rows = [tuple(r) for r in text.doc_sections(d, "id", "html").orderBy("id", "section_no").collect()]
    assert rows == [(1, 0, "", "", "lead"), (1, 1, "h1", "A", "one"), (1, 2, "h2", "B b", "two"), (2, 0, "", "", "")]


def test_trades_with_splits_and_taxes(spark):
    f = spark.createDataFrame([("a", 1, 10.0, 100.0, 0.1), ("a", 3, -5.0, 60.0, 0.1), ("a", 4, 5.0, 40.0, 0.1), ("a", 5, -99.0, 50.0, 0.0), ("b", 1, -1.0, 5.0, 0.1)], "s string, t int, q double, p double, tax double")
    s = spark.createDataFrame([("a", 2, 2.0), ("a", 5, 0.5), ("c", 1, 3.0)], "s string, t int, ratio double")
    got = [tuple(r) for r in market.closed_trades(f, "s", "t", "q", "p", 0.01, s, "tax").orderBy("t").collect()]
    # 20 after the split at a cost of 1010; a quarter goes, 15 and 5 more are halved
    first = (5.0, 252.5, 5 * 60 * 0.89)
    second = (10.0, 757.5 + 202.0, 10 * 50 * 0.99)
    for row, (n, cost, money) in zip(got, (first, second), strict=True):
        assert row[2:] == pytest.approx((n, cost, money, money - cost))


def test_old_shapes_zones_and_channels(spark):
    p = spark.createDataFrame([(1, 10.0), (1, 10.3), (1, 10.8), (1, 12.0), (2, 5.0)], "sid int, price double")
    assert [tuple(r)[1:] for r in technical.zones(p, "sid", "price", 0.05).orderBy("sid", "lo").collect()] == [(0 + 1, 10.0, 10.8, 3), (2, 12.0, 12.0, 1), (1, 5.0, 5.0, 1)]
    lows = spark.createDataFrame([(1, 0, 10.0), (1, 4, 12.0), (1, 8, 13.0)], "sid int, idx int, price double")
    bars = spark.createDataFrame([(1, i, 10.0 + i * 0.45) for i in range(10)], "sid int, idx int, close double")
    got = [(r["x1"], r["x2"], round(r["held"], 4), r["n"], r["rank"]) for r in technical.channels(lows, bars, "sid", "idx", 6, 3).orderBy("rank").collect()]
    want = []
    for (xa, ya), (xb, yb) in (((0, 10.0), (4, 12.0)), ((0, 10.0), (8, 13.0)), ((4, 12.0), (8, 13.0))):
        on = [10 + i * 0.45 >= ya + (yb - ya) / (xb - xa) * (i - xa) for i in range(xa, 10)]
        want.append((-sum(on) / len(on), -len(on), xa, xb))
    assert [(x1, x2, h, n) for x1, x2, h, n, _ in got] == [(a, b, round(-h, 4), -n) for h, n, a, b in sorted(want)]
    d = registry.QUERIES["t12_double_tops"](spark, SF).orderBy("sid", "idx").collect()
    z = technical.zigzag(views.panel(spark, SF), "sid", "idx", 3, 0.3).orderBy("sid", "idx").collect()
    for i, (r, q) in enumerate(zip(d, z, strict=True)):
        before = [x for x in z[max(0, i - 2) : i] if x["sid"] == q["sid"]]
        assert r["double_top"] == (len(before) == 2 and [x["kind"] for x in before] + [q["kind"]] == ["high", "low", "high"] and abs(q["price"] / before[0]["price"] - 1) <= 0.1)


def test_factors_of_the_short_form(spark):
    e = spark.createDataFrame([("a", 1, 2.0), ("a", 5, 5.0), ("a", 9, 3.0), ("b", 1, 2.0), ("b", 1, 3.0), ("c", 4, 2.0)], "sid string, idx int, ratio double")
    j = spark.createDataFrame([("a", 1, 2.1), ("a", 6, 5.0), ("b", 1, 6.0), ("c", 4, 9.0)], "sid string, idx int, ratio double")
    got = {(r["sid"], r["idx"], r["ratio"]): (r["factor_source"], r["apply_at"], r["factor_ok"]) for r in warehouse.adj_factor(e, j, ["sid"], "idx", 2, 0.1).collect()}
    assert got["a", 1, 2.0] == ("nominal", 1, True) and got["a", 5, 5.0] == ("window", 6, True) and got["a", 9, 3.0] == ("raw", 9, True)
    assert got["b", 1, 2.0][0] == got["b", 1, 3.0][0] == "combined" and got["c", 4, 2.0] == ("conflict", 4, False)


def test_sortino_and_growth(spark):
    from tidemark.operators import stats

    d = spark.createDataFrame([("x", f"202{y}-01-0{k}", v) for y, k, v in ((0, 1, 100.0), (0, 2, 110.0), (0, 3, 99.0), (1, 4, 120.0))], "a string, d string, e double").withColumn("d", F.col("d").cast("date"))
    r = stats.performance(d, ["a"], "d", "e").first()
    rets = [0.1, -0.1, 120 / 99 - 1]
    mean = sum(rets) / 3
    assert r["sortino"] == pytest.approx(mean / (0.01 / 3) ** 0.5 * 252**0.5) and r["cagr"] == pytest.approx(1.2 ** (365.25 / 369) - 1)
