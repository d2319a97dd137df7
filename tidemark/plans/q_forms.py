"""Forms, tables with spans, outlines and vendor blobs: pages and bodies made of orders and events, and what they must say."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import forms

from . import views
from .registry import query

C = F.col
L = F.lit


def text(*parts):
    """Texts and columns, one after the other."""
    return F.concat(*[L(p) if isinstance(p, str) else p for p in parts])


# ---- preliminary results


def form_pages(spark, sf):
    """A form for each order, seven of nine faulty or unlike in some way."""
    o = views.read(spark, sf, "orders").select(C("o_orderkey").alias("id"), C("o_orderdate").cast("date").alias("d"), F.floor("o_totalprice").alias("v"), (C("o_orderkey") % 9).alias("k"))
    amount = lambda c: F.format_number(c, 0)
    row = lambda label, now, ago: text(f"<tr><td rowspan=2>{label}</td><td>당해실적</td><td> ", now, " </td><td>1</td><td>2</td><td>-</td><td>", ago, "</td></tr><tr><td>누계실적</td><td>7</td><td></td><td></td><td></td><td></td></tr>")
    day = lambda c: c.cast("string")
    period = text(
        "<table><tr><td>실적기간</td><td colspan=3>날짜</td></tr>", F.when(C("k") == 7, "").otherwise(text("<tr><td>당기실적</td><td>", day(C("d")), "</td><td>~</td><td>", day(F.last_day("d")), "</td></tr>")),
        "<tr><td>전년동기실적</td><td>", day(F.add_months("d", -12)), "</td><td>~</td><td>", day(F.last_day(F.add_months("d", -12))), "</td></tr></table>",
    )
    unit = F.when(C("k") == 4, "달러").when(C("k") == 1, "천원").otherwise("백만원")
    result = text(
        "<table id=Table1><tr><td colspan=7>", F.when(C("k") == 1, "실적 내용").otherwise("연결 실적내용"), "</td></tr><tr><td>구분(단위 : ", unit, ", %)</td><td colspan=6>당기</td></tr>",
        row("매 출 액", amount(C("v")), amount(C("v") + 5)), row("영업이익", F.when(C("k") == 5, "△12").otherwise(amount(-C("v"))), L("-")), row("새항목", L("x"), L("")),
        row("당기순이익", F.when(C("k") == 8, L("")).otherwise(text(amount(C("v")), ".5")), L("0")), "</table>",
    )
    title = F.when(C("k") == 6, "<title>사업보고서</title>").otherwise("<html><title>연결재무제표기준영업(잠정)실적(공정공시)</title>")
    return o.select("id", text(title, period, F.when(C("k") == 2, period).otherwise(""), F.when(C("k") == 3, "").otherwise(result)).alias("html"))


@query("s14_prelim_results", """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % 9 AS k FROM orders WHERE o_orderkey % 9 <> 6), m AS (SELECT *, CASE WHEN k = 1 THEN 1000 ELSE 1000000 END AS m, k IN (0, 1, 8) AS ok FROM o)
    SELECT id, CASE WHEN k NOT IN (2, 3, 7) THEN d END AS period_from, CASE WHEN k NOT IN (2, 3, 7) THEN last_day(d) END AS period_to, CASE WHEN k NOT IN (2, 3, 7) THEN CASE WHEN k = 1 THEN 'standalone' ELSE 'consolidated' END END AS scope, CASE WHEN k NOT IN (2, 3, 7) THEN CASE k WHEN 4 THEN '달러' WHEN 1 THEN '천원' ELSE '백만원' END END AS unit,
    CASE WHEN ok THEN v * m END AS revenue, CASE WHEN ok THEN -v * m END AS op_profit, CASE WHEN ok AND k <> 8 THEN v * m + m // 2 END AS net_income, CASE WHEN ok THEN (v + 5) * m END AS revenue_year_ago, CASE WHEN ok THEN 3 END AS n_items, CASE WHEN ok THEN '새항목' END AS unknown_items,
    CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, CASE k WHEN 2 THEN 'period_table:2' WHEN 3 THEN 'result_table:0' WHEN 4 THEN 'unit:달러' WHEN 5 THEN 'number:영업이익=△12' WHEN 7 THEN 'period' END AS reason FROM m""")
def s14_prelim(spark, sf):
    r = forms.prelim_results(form_pages(spark, sf), "id", "html")
    names = ["period_from", "period_to", "scope", "unit", "revenue", "op_profit", "net_income", "revenue_year_ago", "n_items", "unknown_items", "status", "reason"]
    return r.select("id", *[C(n).cast("bigint").alias(n) if dict(r.dtypes)[n].startswith("decimal") else C(n) for n in names])


# ---- analysts


def analyst_pages(spark, sf):
    """A page a customer: a summary under two rows of headers and a row for each order as a broker's opinion."""
    o = views.read(spark, sf, "orders").select(C("o_custkey").alias("id"), "o_orderkey", "o_orderstatus", F.floor("o_totalprice").alias("v"), C("o_orderdate").cast("date").alias("d"))
    cells = [text(C("o_orderstatus"), " 증권"), F.date_format("d", "yy/MM/dd"), F.format_number("v", 0), F.when(C("o_orderkey") % 3 == 0, "").otherwise(F.format_number(C("v") + 1, 0)), L("1.50"), L("매수"), L("보유")]
    row = text("<tr>", *[text("<td>&nbsp;", c, "</td>") for c in cells], "</tr>")
    g = o.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"), F.count("*").alias("n"), F.max("v").alias("v"), F.max("d").alias("d"))
    k = C("id") % 8
    note = "<tr><td colspan={n}>최근 3개월 이내에 제시된 의견이 없습니다</td></tr>"
    head = "<thead><tr><th rowspan=2>의견</th><th colspan=3>값</th><th rowspan=2>기관수</th></tr><tr><th>목표가</th><th>EPS</th><th>PER</th></tr></thead>"
    values = text("<tr><td>4.00</td><td>", F.format_number("v", 0), "</td><td>-</td><td>1.5</td><td>", F.when(k.isin(3, 4), "").otherwise(C("n").cast("string")), "</td></tr>")
    summary = text("<table id=cTB15>", head, F.when(k == 2, note.format(n=5)).when(k == 5, "<tr><td>1</td><td>2</td></tr>").otherwise(values), "</table>")
    brokers = text("<table id=cTB24><thead><tr>", *[f"<th>{b}</th>" for b in forms.BROKER], "</tr></thead><tbody>", F.when(k == 3, note.format(n=7)).otherwise(C("rows")), "</tbody></table>")
    page = F.when(k == 6, "<script>alert('x');</script>").otherwise(text("<p>[기준:", F.date_format("d", "yyyy.MM.dd"), "]</p>", summary, brokers))
    return g.select("id", page.alias("html"))


@query("s11_analyst_summary", """SELECT o_custkey AS id, CASE WHEN o_custkey % 8 <> 6 THEN strftime(max(o_orderdate), '%Y.%m.%d') END AS base_date, CASE WHEN o_custkey % 8 IN (0, 1, 3, 4, 7) THEN 4.0 END AS opinion_score, CASE WHEN o_custkey % 8 IN (0, 1, 3, 4, 7) THEN CAST(max(floor(o_totalprice)) AS DOUBLE) END AS target_price, CAST(NULL AS DOUBLE) AS eps,
    CASE WHEN o_custkey % 8 IN (0, 1, 3, 4, 7) THEN 1.5 END AS per, CASE WHEN o_custkey % 8 IN (2, 3) THEN 0 WHEN o_custkey % 8 IN (0, 1, 7) THEN count(*) END AS analyst_count, CASE WHEN o_custkey % 8 IN (2, 3) THEN '최근 3개월 이내에 제시된 의견이 없습니다' END AS note, CASE o_custkey % 8 WHEN 2 THEN 'no_opinion' WHEN 5 THEN 'failed' WHEN 6 THEN 'no_data' ELSE 'ok' END AS status FROM orders GROUP BY o_custkey""")
def s11_summary(spark, sf):
    p = analyst_pages(spark, sf)
    return forms.analyst_summary(p, forms.grids(p, "id", "html"), "id", "html", "cTB15", "cTB24")


_BROKERS = """WITH b AS (SELECT o_custkey AS id, o_orderstatus || ' 증권' AS broker, CAST(o_orderdate AS DATE) AS opinion_date, floor(o_totalprice) AS target_price, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice) + 1 END AS prev_target_price, row_number() OVER w AS n, o_orderkey,
    floor(o_totalprice) IS DISTINCT FROM first_value(floor(o_totalprice)) OVER w OR (o_orderkey % 3 <> 0) <> first_value(o_orderkey % 3 <> 0) OVER w AS differs FROM orders WHERE o_custkey % 8 NOT IN (3, 6) WINDOW w AS (PARTITION BY o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) ORDER BY o_orderkey))"""


@query("s11_broker_opinions", _BROKERS + " SELECT id, broker, opinion_date, CAST(target_price AS DOUBLE) AS target_price, CAST(prev_target_price AS DOUBLE) AS prev_target_price, 1.5 AS change_pct, '매수' AS opinion, '보유' AS prev_opinion FROM b WHERE n = 1")
def s11_brokers(spark, sf):
    return forms.broker_opinions(forms.grids(analyst_pages(spark, sf), "id", "html"), "id", "cTB24")[0]


@query("s11_broker_counts", _BROKERS + " SELECT id, 0 AS notes, 0 AS unread, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n > 1 AND differs) AS mismatched FROM b GROUP BY id UNION ALL SELECT DISTINCT o_custkey, 1, 0, 0, 0 FROM orders WHERE o_custkey % 8 = 3")
def s11_counts(spark, sf):
    return forms.broker_opinions(forms.grids(analyst_pages(spark, sf), "id", "html"), "id", "cTB24")[1]


@query("s11_table_records", "SELECT o_custkey AS id, '4.00' AS opinion, format('{:,}', CAST(max(floor(o_totalprice)) AS BIGINT)) AS target, count(*) AS n FROM orders WHERE o_custkey % 8 IN (0, 1, 7) GROUP BY 1")
def s11_records(spark, sf):
    r = forms.records(forms.grids(analyst_pages(spark, sf).where("id % 8 IN (0, 1, 7)"), "id", "html"), "id").where("anchor = 'cTB15'")
    return r.select("id", C("record")["의견"].alias("opinion"), C("record")["값 / 목표가"].alias("target"), C("record")["기관수"].cast("long").alias("n"))


# ---- outlines and corrections


def report_pages(spark, sf):
    """A report a customer: a heading for each year, below it one for each order, some with a table."""
    o = views.read(spark, sf, "orders").select(C("o_custkey").alias("id"), F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderstatus")
    part = text("<h3>order ", C("o_orderkey").cast("string"), "</h3><p>status  ", C("o_orderstatus"), "</p>", F.when(C("o_orderstatus") == "F", "<table><tr><td>a</td></tr></table>").otherwise(""))
    years = o.groupBy("id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))), lambda x: x["p"]), "").alias("p"))
    years = years.withColumn("p", text("<h2>year ", C("y").cast("string"), "</h2>", C("p")))
    g = years.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "p"))), lambda x: x["p"]), "").alias("p"))
    return g.select("id", text("<title>customer ", C("id").cast("string"), "</title>", C("p")).alias("html"))


@query("s16_outline", """WITH o AS (SELECT o_custkey AS id, year(o_orderdate) AS y, o_orderkey AS k, o_orderstatus AS s FROM orders), h AS (SELECT DISTINCT id, 0 AS y, -1 AS k, -1 AS level, '' AS title, '' AS path, '' AS text, 0 AS tables FROM o UNION ALL SELECT DISTINCT id, 0, 0, 0, 'customer ' || id, 'customer ' || id, '', 0 FROM o UNION ALL SELECT DISTINCT id, y, -1, 2, 'year ' || y, 'customer ' || id || ' > year ' || y, '', 0 FROM o
    UNION ALL SELECT id, y, k, 3, 'order ' || k, 'customer ' || id || ' > year ' || y || ' > order ' || k, 'status ' || s || CASE WHEN s = 'F' THEN chr(10) || 'a' ELSE '' END, CASE WHEN s = 'F' THEN 1 ELSE 0 END FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y, k) - 1 AS ordinal FROM h)
    SELECT id, ordinal, level, title, path, CASE WHEN level = 2 THEN 1 WHEN level = 3 THEN max(CASE WHEN level = 2 THEN ordinal END) OVER (PARTITION BY id ORDER BY ordinal) END AS parent, text, tables FROM n""")
def s16_outline(spark, sf):
    return forms.outline(report_pages(spark, sf), "id", "html").select("id", "ordinal", "level", "title", "path", "parent", "text", "tables")


@query("s16_census", "SELECT o_custkey AS id, count(DISTINCT year(o_orderdate)) + count(*) + 1 AS headings, 3 AS deepest, count(*) FILTER (o_orderstatus = 'F') AS tables FROM orders GROUP BY 1")
def s16_census(spark, sf):
    return forms.census(forms.outline(report_pages(spark, sf), "id", "html"), "id").select("id", "headings", "deepest", "tables")


def correction_pages(spark, sf):
    """A first page of a correction for each order: values on the line or in the next cell, odd dates, reasons in a table only."""
    k = C("o_orderkey") % 6
    day = F.date_format("o_orderdate", "yyyy년 M월 d일")
    target = text("<p>1. 정정대상 공시서류 : ", F.when(k == 1, "").otherwise(text("보고서 ", C("o_orderkey").cast("string"))), "</p>", F.when(k == 1, text("<p> </p><p>보고서 ", C("o_orderkey").cast("string"), "</p>")).otherwise(""))
    filed = text("<p>2. 정정대상 공시서류의 최초제출일 : ", F.when(k == 2, "").when(k == 3, "미상").when(k == 4, "2024.13.45").otherwise(day), "</p>", F.when(k == 2, text("<td>", F.date_format("o_orderdate", "yyyy-MM-dd"), " 제출</td>")).otherwise(""))
    reason = F.when(k == 5, "").otherwise("<p>3. 정정사유 : 단순  오기</p>")
    table = "<table><tr><th>항 목</th><th>정정사유</th></tr><tr><td>가</td><td>오기</td></tr><tr><td>나</td><td>누락</td></tr><tr><td>다</td><td>오기</td></tr></table>"
    return views.read(spark, sf, "orders").select(C("o_orderkey").alias("id"), text("<h1>정 정 신 고</h1>", target, filed, reason, "<p>4. 정정사항</p>", table).alias("html"))


@query("s16_correction_fields", "SELECT o_orderkey AS id, '보고서 ' || o_orderkey AS target, CASE o_orderkey % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS filed_date, CASE WHEN o_orderkey % 6 = 5 THEN '오기 | 누락' ELSE '단순 오기' END AS reason, 3 AS n_items FROM orders")
def s16_corrections(spark, sf):
    c = forms.correction_fields(correction_pages(spark, sf), "id", "html")
    return c.select("id", "target", "filed_date", "reason", F.size("items").alias("n_items"))


# ---- blobs


def consensus_blobs(spark, sf):
    """Two compressed bodies a security: one with values, one with averages and ranges; they disagree on some days."""
    b = views.panel(spark, sf).select("sid", "idx", C("d").cast("string").alias("label"), F.round("close", 2).cast("decimal(20,4)").alias("v"))
    rows = b.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", "label", "v"))).alias("rows"))
    main_rows, side_rows = F.filter("rows", lambda r: r["idx"] % 3 != 0), F.filter("rows", lambda r: r["idx"] % 4 != 0)
    main = F.struct(
        L("EPS").alias("select_item_name"), F.transform(main_rows, lambda r: r["label"]).alias("categories"), F.transform(main_rows, lambda r: F.when(r["idx"] % 11 != 0, r["v"])).alias("select_item"),
        F.transform(main_rows, lambda r: r["v"] + 1).alias("close_price"), F.transform(main_rows, lambda r: r["v"] + 2).alias("target_price"),
    )
    side = F.struct(
        L("EPS").alias("item_name"), F.transform(side_rows, lambda r: r["label"]).alias("categories"), F.transform(side_rows, lambda r: F.when(r["idx"] % 7 != 0, F.when(r["idx"] % 5 == 0, r["v"] + 3).otherwise(r["v"]))).alias("avg"),
        F.transform(side_rows, lambda r: F.array(r["v"] - 1, r["v"] + 4)).alias("min_max"),
    )
    body = lambda s: F.to_json(F.create_map(L("c1"), F.to_json(s, {"ignoreNullFields": "false"})))
    both = rows.select("sid", F.explode(F.array(F.struct(L("main").alias("endpoint"), body(main).alias("t")), F.struct(L("side").alias("endpoint"), body(side).alias("t")))).alias("e")).select("sid", "e.*")
    held = F.when((C("sid") % 10 == 4) & (C("endpoint") == "main"), "[1, 2]").otherwise(C("t"))
    packed = F.when((C("sid") % 10 == 3) & (C("endpoint") == "side"), F.encode("t", "UTF-8")).otherwise(forms.deflate(held))
    return both.select("sid", "endpoint", packed.alias("body"))


_CONSENSUS = """, p AS (SELECT sid, idx, CAST(CAST(d AS DATE) AS VARCHAR) AS label, round(close, 2) AS v FROM panel), m AS (SELECT *, CASE WHEN idx % 11 <> 0 THEN v END AS value FROM p WHERE idx % 3 <> 0 AND sid % 10 <> 4), s AS (SELECT *, CASE WHEN idx % 7 <> 0 THEN CASE WHEN idx % 5 = 0 THEN v + 3 ELSE v END END AS a FROM p WHERE idx % 4 <> 0 AND sid % 10 <> 3)"""


@query("s07_monthly_consensus", _CONSENSUS + """ SELECT coalesce(m.sid, s.sid) AS sid, 'EPS' AS metric, coalesce(m.label, s.label) AS label, CASE WHEN m.sid IS NULL THEN a ELSE value END AS value, m.v + 1 AS close, m.v + 2 AS target, s.v - 1 AS lo, s.v + 4 AS hi,
    CASE WHEN s.sid IS NULL THEN 'main' WHEN m.sid IS NULL THEN 'side' WHEN (value IS NULL) <> (a IS NULL) THEN 'one_empty' WHEN value <> a THEN 'mismatch' ELSE 'both' END AS seen FROM m FULL JOIN s ON m.sid = s.sid AND m.label = s.label""", "panel")
def s07_consensus(spark, sf):
    rows, _ = forms.monthly_consensus(consensus_blobs(spark, sf), ["sid"], "endpoint", "body", "main", "side")
    return rows.select("sid", "metric", "label", *[C(c).cast("double").alias(c) for c in ("value", "close", "target", "lo", "hi")], "seen")


@query("s07_rejected_blobs", "SELECT DISTINCT sid, CASE WHEN sid % 10 = 3 THEN 'side' ELSE 'main' END AS endpoint, CASE WHEN sid % 10 = 3 THEN 'not_compressed_text' ELSE 'not_an_object' END AS reason FROM panel WHERE sid % 10 IN (3, 4)", "panel")
def s07_rejects(spark, sf):
    return forms.monthly_consensus(consensus_blobs(spark, sf), ["sid"], "endpoint", "body", "main", "side")[1]
