"""Tables with spans, forms and their reasons, outlines, corrections, blobs: pages written by hand."""

from __future__ import annotations

import datetime
import json
import zlib

import pytest

from tests.conftest import DATA
from tidemark.plans import q_forms
from tidemark.sources import forms

SF = f"{DATA}/sf0.001"


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "id int, html string")


def test_spans_are_written_out():
    rows = forms.grid_rows("""<table id=a><thead><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><th>x</th><th>y</th></tr></thead>
        <tr><td rowspan="3" colspan=2>1</td><td>2</td></tr><tr><td>3</td></tr><tr><td>4<td>5</tr></table><table><tr><td>t<table id=in><tr><td>n</td></tr></table></td></tr></table><td>loose</td>""")
    assert [r[1:] for r in rows if r[0] == 0] == [
        ("a", 0, True, ["A", "B", "B"]), ("a", 1, True, ["A", "x", "y"]), ("a", 2, False, ["1", "1", "2"]), ("a", 3, False, ["1", "1", "3"]), ("a", 4, False, ["1", "1", "4", "5"]),
    ]
    assert [(r[0], r[1], r[4]) for r in rows if r[0]] == [(1, None, ["t"]), (2, "in", ["n"])]
    assert forms.grid_rows("") == [] and forms.grid_rows("<table><td colspan=x rowspan=0>a") == [(0, None, 0, False, ["a"])]


def test_headers_of_several_rows_name_the_columns(spark):
    p = pages(spark, "<table><tr><th rowspan=2>A</th><th colspan=2>B</th><th>A</th></tr><tr><th>x</th><th></th><th>A</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table><table><tr><td>no header</td></tr></table>")
    got = forms.records(forms.grids(p, "id", "html"), "id").collect()
    assert [r["record"] for r in got] == [{"A": "1", "B / x": "2", "B": "3", "A 2": "4"}]


NOTE = "최근 3개월 이내에 제시된 의견이 없습니다"


def test_analyst_pages(spark):
    table = lambda a, *rows: f"<table id={a}>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    p = pages(
        spark, table("s", ["4.0", "1,000", "10", "5.5", "3"]) + "[기준:2024.01.05]", table("s", [NOTE]), table("s", ["", "", "", "", "&nbsp;"]) + table("b", [NOTE]), table("s", ["", "", "", "", ""]),
        table("s", ["1", "2", "3"]), "<script>alert('go')</script>", "nothing", "alert(" + "x" * 2000, table("s", ["최근 6개월 의견 없음"]),
    )
    rows = forms.grids(p, "id", "html")
    got = {r["id"]: r for r in forms.analyst_summary(p, rows, "id", "html", "s", "b").collect()}
    assert [got[i]["status"] for i in range(9)] == ["ok", "no_opinion", "ok", "ok", "failed", "no_data", "failed", "failed", "no_opinion"]
    assert (got[0]["base_date"], got[0]["target_price"], got[0]["analyst_count"]) == ("2024.01.05", 1000.0, 3)
    assert got[1]["analyst_count"] == 0 and got[1]["note"] == NOTE
    assert got[2]["analyst_count"] == 0 and got[2]["note"] == NOTE and got[2]["status"] == "ok"
    assert got[3]["analyst_count"] is None and got[3]["status"] == "ok" and got[8]["analyst_count"] is None


def test_broker_rows(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    p = pages(spark, "<table id=b>" + row("A", "24/01/05", "1,000", "", "-5", "Buy", "Hold") + row("A", "24/01/05", "2,000", "", "-5", "Buy", "Hold") + row("A", "24/01/05", "1,000", "", "-5", "Buy", "Hold") + row("B", "99/12/31", "x", "7", "", "Sell", "") + row("C", "1") + row(NOTE) + "</table>")
    kept, counts = forms.broker_opinions(forms.grids(p, "id", "html"), "id", "b")
    assert [tuple(r)[1:5] for r in kept.orderBy("broker").collect()] == [("A", datetime.date(2024, 1, 5), 1000.0, None), ("B", datetime.date(1999, 12, 31), None, 7.0)]
    assert tuple(counts.first())[1:] == (1, 1, 2, 1)


PERIOD = "<table><tr><td>실적기간</td></tr><tr><td>당기실적</td><td>2026-07-01</td><td>~</td><td>2026-09-30</td></tr>{ago}</table>"
AGO = "<tr><td>전년동기실적</td><td>2025-07-01</td><td>~</td><td>2025-09-30</td></tr>"
RESULT = "<table><tr><td>{scope} (단위 : {unit})</td></tr>{rows}</table>"


def item(label, now, ago="0", mark="당해실적"):
    return f"<tr><td>{label}</td><td>{mark}</td><td>{now}</td><td></td><td></td><td></td><td>{ago}</td></tr>"


def form(rows, scope="연결실적내용", unit="백만원", ago=AGO, title="영업(잠정)실적", extra=""):
    return f"<title>{title}</title>" + PERIOD.format(ago=ago) + extra + RESULT.format(scope=scope, unit=unit, rows=rows)


def test_each_reason_of_a_form(spark):
    good = item("매출액", "1,237,395", "1") + item("영업이익", "-", "-") + item("당기순이익", "-12.5", "")
    cases = {
        form(good): (None, 1237395000000), form(good, unit="원"): ("number:당기순이익=-12.5", None), form(good, unit="EUR"): ("unit:EUR", None), form(good, unit=""): ("unit:none", None), form(good, scope="내용"): ("scope", None),
        form(good, extra=PERIOD.format(ago="")): ("period_table:2", None), form(""): ("result_table:0", None), form(good).replace("2026-07-01", "2026.07.01"): ("period", None),
        form(item("매출액", "(5)")): ("number:매출액=(5)", None), form(item("매출액", "5", "△1")): ("number:매출액=△1", None), form(item("지배기업소유주지분순이익", "5", "△1")): (None, None), form(item("매출액", "1,2345")): ("number:매출액=1,2345", None),
        form(good + item("기타", "x"), ago=""): (None, 1237395000000), form(good + item("매출액", "9", mark="누계실적")): (None, 1237395000000),
    }
    got = {r["id"]: r for r in forms.prelim_results(pages(spark, *cases, form(good, title="다른"), "", "<title>영업(잠정)실적"), "id", "html").collect()}
    for i, (reason, revenue) in enumerate(cases.values()):
        assert (got[i]["reason"], got[i]["revenue"]) == (reason, revenue), i
        assert got[i]["status"] == ("failed" if reason else "ok")
    n = len(cases)
    assert n not in got and n + 1 not in got and got[n + 2]["reason"] == "period_table:0"
    first = got[0]
    assert (first["period_from"], first["year_ago_to"], first["scope"]) == (datetime.date(2026, 7, 1), datetime.date(2025, 9, 30), "consolidated")
    assert (first["op_profit"], first["net_income"], first["net_income_year_ago"], first["n_items"], first["unknown_items"]) == (None, -12500000, None, 3, "")
    assert got[12]["unknown_items"] == "기타" and got[12]["year_ago_from"] is None


def test_outline_of_odd_levels(spark):
    p = pages(spark, "<p>before</p><h2>a</h2>x<h4>b</h4><p>y</p><p>z</p><h3>c</h3><h1>d</h1><h6>e<b>f</b></h6><script>no</script><table><tr><td>t</td></tr></table><a>l</a>", "", "<title>only</title>")
    rows = forms.outline(p, "id", "html").orderBy("id", "ordinal").collect()
    assert [(r["level"], r["path"], r["parent"]) for r in rows if r["id"] == 0] == [(-1, "", None), (2, "a", None), (4, "a > b", 1), (3, "a > c", 1), (1, "d", None), (6, "d > ef", 4)]
    assert [r["text"] for r in rows if r["id"] == 0] == ["before", "x", "y\nz", "", "", "t\nl"]
    assert [(r["ordinal"], r["level"], r["path"]) for r in rows if r["id"] > 0] == [(0, -1, ""), (0, -1, ""), (1, 0, "only")]
    c = {r["id"]: tuple(r)[1:] for r in forms.census(forms.outline(p, "id", "html"), "id").collect()}
    assert c[0][:2] == (5, 6) and c[0][3:5] == (1, 1) and c[1] == (0, -1, 0, 0, 0, 0)


def test_correction_without_values_and_on_other_pages(spark):
    p = pages(spark, "<p>1. 정정대상 공시서류 :</p><p>2. 정정대상 공시서류의 최초제출일 : 20011년 1월 1일</p><p>3. 정정사유</p><p>4. 정정사항</p>", "<p>nothing</p>", "<p>최초제출일 2024-02-30</p>", "<p>최초 제출일 :</p><p>항 목</p><p>2024-01-01</p>")
    got = {r["id"]: r for r in forms.correction_fields(p, "id", "html").collect()}
    assert sorted(got) == [0, 2, 3]
    assert (got[0]["target"], got[0]["filed_date"], got[0]["reason"], got[0]["items"]) == (None, None, None, [])
    assert got[2]["filed_raw"] == "2024-02-30" and got[2]["filed_date"] is None and got[3]["filed_date"] is None


def test_blobs_that_cannot_be_read(spark):
    z = lambda x: zlib.compress(x if isinstance(x, bytes) else json.dumps(x).encode())
    chart = {"select_item_name": "EPS", "categories": ["a", "a", "b"], "select_item": [1, 2, None], "close_price": [5.5, None], "target_price": []}
    side = {"item_name": "EPS", "categories": ["b", "c"], "avg": [7, 8.25], "min_max": [[1, 2], []]}
    blobs = [(1, "m", z({"x": json.dumps(chart)})), (1, "s", z({"x": side})), (2, "m", b"plain"), (3, "m", z(b"\xff\xfe")), (4, "m", z("text")), (5, "m", z({"x": "[1]"})), (6, "m", None), (7, "m", z({"x": {"select_item_name": "EPS", "categories": []}}))]
    rows, rejects = forms.monthly_consensus(spark.createDataFrame(blobs, "k int, e string, body binary"), ["k"], "e", "body", "m", "s")
    assert {r["k"]: r["reason"] for r in rejects.collect()} == {2: "not_compressed_text", 3: "not_compressed_text", 4: "not_an_object", 5: "chart_not_an_object", 6: "not_compressed_text"}
    got = {(r["k"], r["label"]): (r["value"], r["seen"], r["hi"]) for r in rows.collect()}
    assert {k: (None if v is None else float(v), s) for k, (v, s, _) in got.items()} == {(1, "a"): (1.0, "main"), (1, "b"): (None, "one_empty"), (1, "c"): (8.25, "side")}


@pytest.mark.parametrize("made", [q_forms.form_pages, q_forms.analyst_pages, q_forms.report_pages, q_forms.correction_pages])
def test_pages_are_one_an_id(spark, made):
    p = made(spark, SF)
    assert p.count() == p.select("id").distinct().count() > 0
