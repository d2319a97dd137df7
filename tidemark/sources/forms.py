"""Filings and vendor pages: tables with their spans written out, forms, outlines, compressed blobs.

A page becomes rows once (grids, headings); which table is meant, what a cell says and why a page fails are expressions on
those rows. The rows of one page are brought together by its id; nothing else is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col
PAGES_AT_ONCE = 250  # pages whose rows a task holds in Python
GRID = "table_no int, anchor string, row_no int, head boolean, cells array<string>"


def fold(text: str) -> str:
    return " ".join(text.split())


#: A tag of plain letters and digits with plain attributes.
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z]+=(?:[A-Za-z0-9_-]+|\"[^\"<>&]*\"))*)>")
BRACKETS = re.compile(r"(<[^<>]*>)")
ATTRIBUTE = re.compile(r"([A-Za-z]+)=(?:\"([^\"]*)\"|([A-Za-z0-9_-]+))")
#: Elements in which the library reads text, not tags.
RAW = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


@lru_cache(10_000)
def plain_tag(tag: str) -> tuple[bool, str, list[tuple[str, str]]] | None:
    """(is an end, name, attributes) of a tag with its brackets; None if it isn't plain. Pages have few different tags."""
    m = TAG.fullmatch(tag)
    if m is None or m[2].lower() in RAW or (m[1] and m[3]):
        return None
    return bool(m[1]), m[2].lower(), [(n.lower(), q or v) for n, q, v in ATTRIBUTE.findall(m[3])]


short_text = lru_cache(10_000)(unescape)


def plain_text(text: str) -> str:
    return text if "&" not in text else short_text(text) if len(text) < 50 else unescape(text)


def plain_parts(page: str) -> tuple[list[str], list[tuple[bool, str, list[tuple[str, str]]]]] | None:
    """(texts, tags) of a page of plain tags only, as one pattern cuts it; None if the library must read it."""
    parts = BRACKETS.split(page)
    texts, tags = parts[0::2], [plain_tag(t) for t in parts[1::2]]
    # a tag has no < but its first
    if None in tags or page.count("<") != len(tags):
        return None
    # a title's tags would be text
    if "<title" in page.lower() and not all(n + 1 < len(tags) and tags[n + 1][:2] == (True, "title") for n, (end, tag, _) in enumerate(tags) if tag == "title" and not end):
        return None
    return texts, tags


def read_page(parser: HTMLParser, page: str) -> None:
    """What the library's feed and close tell the parser. Pages of plain tags only are cut by one pattern, all else by the library."""
    cut = plain_parts(page)
    if cut is None:
        parser.feed(page)
        parser.close()
        return
    texts, tags = cut
    if texts[0]:
        parser.handle_data(plain_text(texts[0]))
    for (end, tag, attrs), text in zip(tags, texts[1:], strict=True):
        if end:
            parser.handle_endtag(tag)
        else:
            parser.handle_starttag(tag, attrs)
        if text:
            parser.handle_data(plain_text(text))


# ---- tables


class _Cells(HTMLParser):
    """Tables of a page: (anchor, rows), a row a list of [text, rows spanned, columns spanned, is a header].

    Plain pages are told apart by begin and end alone, without the library's calls for every tag and text.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str | None, list[list[list]]]] = []
        self.around: list[list[list[list]]] = []  # the rows of the tables around
        self.cell: list | None = None
        self.heads = 0
        cut = plain_parts(page)
        if cut is None:
            self.feed(page)
            self.close()
            return
        for (end, tag, attrs), text in zip(cut[1], cut[0][1:], strict=True):
            if tag in self.TAGS:
                if not end:
                    self.begin(tag, dict(attrs) if attrs else {})
                elif tag == "td":
                    self.cell = None
                else:
                    self.handle_endtag(tag)
            if text and self.cell is not None:
                self.cell[0] += plain_text(text)

    TAGS = frozenset(("table", "thead", "tr", "td", "th"))

    def begin(self, tag: str, a: dict) -> None:
        if tag in ("td", "th"):
            if self.around:
                rows = self.around[-1]
                if not rows:
                    rows.append([])
                down, across = [min(int(v), 1000) if (v := a.get(n) or "1").isdigit() and int(v) else 1 for n in ("rowspan", "colspan")] if a else (1, 1)
                self.cell = ["", down, across, tag == "th" or self.heads > 0]
                rows[-1].append(self.cell)
        elif tag == "tr":
            if self.around:
                self.around[-1].append([])
                self.cell = None
        elif tag == "table":
            self.tables.append((a.get("id"), []))
            self.around.append(self.tables[-1][1])
            self.cell = None
        elif tag == "thead":
            self.heads += 1

    def handle_starttag(self, tag, attrs):
        self.begin(tag, dict(attrs))

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.around:
            self.around.pop()
            self.cell = None
        elif tag == "thead":
            self.heads = max(0, self.heads - 1)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def grid_rows(page: str) -> list[tuple[int, str | None, int, bool, list[str]]]:
    """(table, anchor, row, head, cells): every cell stands in all places that it spans; head if all its cells are headers."""
    out = []
    for t, (anchor, rows) in enumerate(_Cells(page).tables):
        below: dict[int, tuple[str, int, bool]] = {}  # column -> what hangs into the next row
        for r, row in enumerate(rows):
            if not below and all(down == 1 and across == 1 for _, down, across, _ in row):
                out.append((t, anchor, r, bool(row) and all(c[3] for c in row), [fold(c[0]) for c in row]))
                continue
            line: dict[int, tuple[str, bool]] = {}
            hang = {}
            for c, (text, left, head) in below.items():
                line[c] = (text, head)
                if left > 1:
                    hang[c] = (text, left - 1, head)
            at = 0
            for text, down, across, head in row:
                while at in line:
                    at += 1
                for c in range(at, at + across):
                    line[c] = (fold(text), head)
                    if down > 1:
                        hang[c] = (fold(text), down - 1, head)
                at += across
            below = hang
            cells = [line.get(c, ("", False)) for c in range(max(line, default=-1) + 1)]
            out.append((t, anchor, r, bool(cells) and all(h for _, h in cells), [x for x, _ in cells]))
    return out


def _per_page(pages: DataFrame, id_: str, html: str, schema: str, rows) -> DataFrame:
    """Rows of every page: (id, schema)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PAGES_AT_ONCE):
                b = whole.iloc[at : at + PAGES_AT_ONCE]
                yield pd.DataFrame([(i, *row) for i, h in zip(b["id"], b["html"], strict=True) for row in rows(h or "")], columns=["id", *names])

    kind = pages.schema[id_].dataType.simpleString()
    return pages.select(C(id_).alias("id"), C(html).alias("html")).mapInPandas(run, f"id {kind}, {schema}").withColumnRenamed("id", id_)


def grids(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, table_no, anchor, row_no, head, cells): every row of every table, spans written out."""
    return _per_page(pages, id_, html, GRID, grid_rows)


def page_tables(page: str) -> tuple[list[list[list[str]]]]:
    return ([[cells for *_, cells in rows] for _, rows in groupby(grid_rows(page), key=lambda row: row[0])],)


def nested_grids(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, tables) a page: its tables with rows, each the cells of its rows, spans written out. Rows of a page need no grouping."""
    return _per_page(pages, id_, html, "tables array<array<array<string>>>", lambda page: [page_tables(page)])


def records(rows: DataFrame, id_: str) -> DataFrame:
    """(id, table_no, anchor, row_no, record) of the rows below each table's header, record a map from column to cell.

    The rows of headers at a table's top are joined: a column is named by its headers from above, equal ones once, as
    "Price / High". Columns with one name are numbered from the second on. Tables without header rows have no records.
    """
    table = Window.partitionBy(id_, "table_no").orderBy("row_no")
    d = rows.withColumn("__top", F.min(C("head").cast("int")).over(table.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    heads = F.collect_list(F.when(C("__top"), C("cells"))).over(Window.partitionBy(id_, "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("__heads", heads).where("NOT __top AND size(__heads) > 0")
    column = lambda i: F.array_join(F.array_distinct(F.filter(F.transform("__heads", lambda h: F.get(h, i)), lambda x: x.isNotNull() & (x != ""))), " / ")
    d = d.withColumn("__names", F.transform(C("cells"), lambda _, i: column(i)))
    again = lambda x, i: F.size(F.filter(F.slice("__names", 1, i), lambda y: y == x))
    d = d.withColumn("__names", F.transform("__names", lambda x, i: F.when(again(x, i) > 0, F.concat(x, F.lit(" "), (again(x, i) + 1).cast("string"))).otherwise(x)))
    return d.select(id_, "table_no", "anchor", "row_no", F.map_from_arrays("__names", "cells").alias("record"))


# ---- analysts

#: What a page says where nobody has an opinion.
NO_OPINION = "최근 *3 *개월.*의견이 *없습니다"
SUMMARY = ["opinion_score", "target_price", "eps", "per", "analyst_count"]
BROKER = ["broker", "opinion_date", "target_price", "prev_target_price", "change_pct", "opinion", "prev_opinion"]


def number(c: Column) -> Column:
    """1,234.5 as a number; null for anything else."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def full_date(c: Column) -> Column:
    """yy/MM/dd as a date; years from 70 on are those of the last century."""
    return F.concat(F.when(c < "70", "20").otherwise("19"), F.replace(c, F.lit("/"), F.lit("-"))).try_cast("date")


def analyst_summary(pages: DataFrame, rows: DataFrame, id_: str, html: str, anchor: str, broker_anchor: str) -> DataFrame:
    """(id, base_date, SUMMARY, note, status) a page, from the last row of the table named anchor.

    status: ok; no_opinion where the row is one note (an analyst count of 0 if it speaks of three months, also where the
    count is empty and the brokers' table holds just that note); no_data for a short page that only redirects; else failed.
    """
    # both tables by one grouping, so that the pages are read once
    mine, theirs = (C("anchor") == anchor) & ~C("head"), (C("anchor") == broker_anchor) & ~C("head")
    g = rows.where(mine | theirs).groupBy(id_).agg(
        F.max_by(F.when(mine, C("cells")), F.when(mine, F.struct(-C("table_no"), C("row_no")))).alias("cells"),
        F.count_if(theirs).alias("__n"), F.max(F.when(theirs, C("cells")[0])).alias("said"), F.max(F.when(theirs, F.size(F.array_distinct("cells")))).alias("__width"),
    )
    said = F.when((C("__n") == 1) & (C("__width") == 1) & C("said").rlike(NO_OPINION), C("said"))
    base = F.nullif(F.regexp_extract(html, r"\[기준:([0-9.]+)\]", 1), F.lit(""))
    redirect = C(html).contains("alert(") & (F.length(html) < 1000)
    d = pages.select(id_, base.alias("base_date"), redirect.alias("__redirect")).join(g.select(id_, "cells", said.alias("said")), id_, "left")
    one = F.size(F.array_distinct("cells")) == 1
    status = F.when(C("cells").isNull(), F.when(C("__redirect"), "no_data").otherwise("failed")).when(one & (C("cells")[0] != ""), "no_opinion").when(F.size("cells") == len(SUMMARY), "ok").otherwise("failed")
    d = d.withColumn("status", status)
    value = lambda i: F.when(C("status") == "ok", number(F.get("cells", F.lit(i))))
    note = F.when(C("status") == "no_opinion", C("cells")[0]).when((C("status") == "ok") & value(4).isNull(), C("said"))
    d = d.withColumn("note", note)
    count = F.when(C("note").rlike(NO_OPINION), 0.0).otherwise(value(4))
    return d.select(id_, "base_date", *[value(i).alias(n) for i, n in enumerate(SUMMARY[:4])], count.cast("int").alias(SUMMARY[4]), "note", "status")


def broker_opinions(rows: DataFrame, id_: str, anchor: str) -> tuple[DataFrame, DataFrame]:
    """(id, BROKER) for each broker and date of a page's table, and (id, notes, unread, repeated, mismatched) a page.

    Of repeated rows the first stays; mismatched counts those that say something else.
    """
    d = rows.where((C("anchor") == anchor) & ~C("head")).withColumn("kind", F.when(F.size(F.array_distinct("cells")) == 1, "note").when(F.size("cells") == len(BROKER), "row").otherwise("unread"))
    w = Window.partitionBy(id_, "kind", *[F.get("cells", F.lit(i)) for i in (0, 1)]).orderBy("table_no", "row_no")
    d = d.withColumn("n", F.row_number().over(w)).withColumn("differs", C("cells") != F.first("cells").over(w))
    kept = d.where("kind = 'row' AND n = 1")
    fields = [full_date(C("cells")[i]).alias(n) if n.endswith("date") else number(C("cells")[i]).alias(n) if "p" in n and n.startswith(("target", "prev_target", "change")) else C("cells")[i].alias(n) for i, n in enumerate(BROKER)]
    again = (C("kind") == "row") & (C("n") > 1)
    counts = d.groupBy(id_).agg(F.count_if(C("kind") == "note").alias("notes"), F.count_if(C("kind") == "unread").alias("unread"), F.count_if(again).alias("repeated"), F.count_if(again & C("differs")).alias("mismatched"))
    return kept.select(id_, *fields), counts


# ---- preliminary results

# The form's words.
FORM_TITLE = r"(?i)<title>[^<]*영업\(잠정\)실적"
PERIOD_HEAD, RESULT_MARK, NOW, YEAR_AGO = "실적기간", "당해실적", "당기실적", "전년동기실적"
CONSOLIDATED, STANDALONE = "연결실적내용", "실적내용"
ITEMS = {"매출액": "revenue", "영업이익": "op_profit", "법인세비용차감전계속사업이익": "pretax", "당기순이익": "net_income", "지배기업소유주지분순이익": "ni_owner"}
ITEMS_YEAR_AGO = ["revenue", "op_profit", "net_income"]
UNITS = {"원": 1, "천원": 10**3, "백만원": 10**6, "억원": 10**8, "조원": 10**12}


def prelim_results(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """A row for each page that is the form: (id, period_from, period_to, year_ago_from, year_ago_to, scope, unit, items'
    values and those of a year ago in won, n_items, unknown_items, status, reason).

    The period table is the one that begins with its head; the result table the one with rows of seven cells and the mark.
    status is failed with a reason: period_table:n or result_table:n (not one of them), period, scope, unit:x, number:item=x
    (the first that cannot be read; - and nothing are null). Values are then null; what was read before stays.
    """
    d = nested_grids(pages.where(C(html).substr(1, 4000).rlike(FORM_TITLE)), id_, html)
    marked = lambda r: (F.size(r) >= 7) & (F.get(r, F.lit(1)) == RESULT_MARK)
    first = lambda t: F.get(F.get(t, F.lit(0)), F.lit(0))
    d = d.withColumns({"p": F.filter("tables", lambda t: first(t) == PERIOD_HEAD), "r": F.filter("tables", lambda t: F.exists(t, marked))})
    d = d.select(id_, F.size("p").alias("n_period"), F.size("r").alias("n_result"), F.get("p", F.lit(0)).alias("p"), F.get("r", F.lit(0)).alias("r"))
    day = lambda x: F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})$", 0)

    def span(label: str) -> Column:
        found = F.get(F.filter("p", lambda r, i: (i > 0) & (F.get(r, F.lit(0)) == label)), F.lit(0))
        days = F.filter(F.transform(F.slice(found, 2, 100), day), lambda x: x != "")
        return F.when(F.size(days) == 2, F.transform(days, lambda x: x.cast("date")))

    d = d.withColumn("now", span(NOW)).withColumn("ago", span(YEAR_AGO))
    flat = F.replace(F.array_join(F.flatten("r"), ""), F.lit(" "), F.lit(""))
    d = d.withColumn("scope", F.when(flat.contains(CONSOLIDATED), "consolidated").when(flat.contains(STANDALONE), "standalone"))
    unit = F.transform(F.flatten("r"), lambda x: F.regexp_extract(x, r"단위\s*[:：]\s*([^\s,)]+)", 1))
    d = d.withColumn("unit", F.get(F.filter(unit, lambda x: x != ""), F.lit(0)))
    units = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    d = d.withColumn("mult", F.try_element_at(units, C("unit")).cast("decimal(38,6)"))
    names = F.create_map(*[F.lit(v) for kv in ITEMS.items() for v in kv])
    read = F.filter("r", marked)
    d = d.withColumn("read", F.transform(read, lambda r: F.struct(F.try_element_at(names, F.replace(r[0], F.lit(" "), F.lit(""))).alias("item"), r[0].alias("label"), F.trim(r[2]).alias("now"), F.trim(r[6]).alias("ago"))))
    d = d.withColumn("known", F.filter("read", lambda x: x["item"].isNotNull()))
    empty = lambda x: x.isin("", "-")
    won = lambda x: F.when(x.rlike(r"^-?[0-9]{1,3}(,?[0-9]{3})*(\.[0-9]+)?$"), F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(28,6)") * C("mult"))
    unread = lambda x: ~empty(x) & (won(x).isNull() | (won(x) != F.floor(won(x))))
    asks_ago = lambda x: x["item"].isin(ITEMS_YEAR_AGO)
    bad = F.filter("known", lambda x: unread(x["now"]) | (asks_ago(x) & unread(x["ago"])))
    first_bad = F.get(bad, F.lit(0))
    reason = (
        F.when(C("n_period") != 1, F.concat(F.lit("period_table:"), C("n_period").cast("string")))
        .when(C("n_result") != 1, F.concat(F.lit("result_table:"), C("n_result").cast("string")))
        .when(C("now").isNull(), "period").when(C("scope").isNull(), "scope")
        .when(C("mult").isNull(), F.concat(F.lit("unit:"), F.coalesce("unit", F.lit("none"))))
        .when(F.size(bad) > 0, F.concat(F.lit("number:"), first_bad["label"], F.lit("="), F.when(unread(first_bad["now"]), first_bad["now"]).otherwise(first_bad["ago"])))
    )
    d = d.withColumn("reason", reason)
    ok = C("reason").isNull()

    def value(item: str, which: str) -> Column:
        cell = F.element_at(F.filter("known", lambda x: x["item"] == item), -1)[which]
        return F.when(ok & (F.size(F.filter("known", lambda x: x["item"] == item)) > 0), won(cell)).cast("decimal(38,0)")

    # what a page tells after its first fault is not read
    at = F.when(C("reason").startswith("period_table") | C("reason").startswith("result_table"), 1).when(C("reason") == "period", 2).otherwise(9)
    keep = lambda c, n: F.when(at > n, c)
    return d.select(
        id_, keep(C("now")[0], 2).alias("period_from"), keep(C("now")[1], 2).alias("period_to"), keep(C("ago")[0], 2).alias("year_ago_from"), keep(C("ago")[1], 2).alias("year_ago_to"),
        keep(C("scope"), 2).alias("scope"), keep(C("unit"), 2).alias("unit"), *[value(i, "now").alias(i) for i in ITEMS.values()], *[value(i, "ago").alias(f"{i}_year_ago") for i in ITEMS_YEAR_AGO],
        F.when(ok, F.size("known")).alias("n_items"), F.when(ok, F.array_join(F.transform(F.filter("read", lambda x: x["item"].isNull()), lambda x: x["label"]), "|")).alias("unknown_items"),
        F.when(ok, "ok").otherwise("failed").alias("status"), "reason",
    )


# ---- outlines


class _Outline(HTMLParser):
    """Headings with what follows each up to the next; blocks of text are lines."""

    LEVELS = {"title": 0, **{f"h{i}": i for i in range(1, 7)}}
    BLOCKS = {"p", "td", "th", "tr", "table", "li", "div", *LEVELS}
    HIDDEN = {"script", "style"}

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.parts = [[-1, [], [], 0, 0, 0]]  # level, title, text, elements, tables, links
        self.heading = self.hidden = None
        read_page(self, page)

    def handle_starttag(self, tag, attrs):
        if tag in self.LEVELS:
            self.parts.append([self.LEVELS[tag], [], [], 0, 0, 0])
            self.heading = tag
        elif tag in self.HIDDEN:
            self.hidden = tag
        now = self.parts[-1]
        now[3] += 1
        now[4] += tag == "table"
        now[5] += tag == "a"

    def handle_endtag(self, tag):
        if tag == self.heading:
            self.heading = None
        elif tag == self.hidden:
            self.hidden = None
        elif tag in self.BLOCKS:
            self.parts[-1][2].append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts[-1][1 if self.heading else 2].append(data)


def _outline_rows(page: str):
    for n, (level, title, text, elements, tables, links) in enumerate(_Outline(page).parts):
        lines = "\n".join(x for line in "".join(text).split("\n") if (x := fold(line)))
        yield n, level, fold("".join(title)), lines, elements, tables, links


def outline(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, ordinal, level, title, path, parent, text, elements, tables, links): a page's headings in order.

    path is the titles of the headings that a heading stands under and its own; parent the ordinal of the nearest of them.
    A heading ends all of its level and deeper. Ordinal 0 with level -1 is what stands before the first heading. The figures
    are of the part up to the next heading; text has a line a block.
    """
    rows = _per_page(pages, id_, html, "ordinal int, level int, title string, text string, elements int, tables int, links int", _outline_rows)
    w = Window.partitionBy(id_).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    above = []
    for n in range(6):
        last = F.last(F.when(C("level") == n, F.struct("ordinal", "title")), True).over(w)
        rows = rows.withColumn(f"__l{n}", last)
        above.append(C(f"__l{n}"))
    # a heading is still open if none of its level or above came after it
    still = []
    for n, c in enumerate(above):
        closed = F.greatest(F.lit(-2), F.lit(-1), *[x["ordinal"] for x in above[:n]])
        still.append(F.when(c.isNotNull() & (n < C("level")) & (c["ordinal"] > closed), c))
    rows = rows.withColumn("__open", F.array_compact(F.array(*still)))
    path = F.array_join(F.concat(F.transform("__open", lambda x: x["title"]), F.array("title")), " > ")
    return rows.select(id_, "ordinal", "level", "title", path.alias("path"), F.try_element_at("__open", F.lit(-1))["ordinal"].alias("parent"), "text", "elements", "tables", "links")


def census(parts: DataFrame, id_: str) -> DataFrame:
    """(id, headings, deepest, elements, tables, links, chars) a page, from outline."""
    return parts.groupBy(id_).agg(
        F.count_if(C("level") >= 0).alias("headings"), F.max("level").alias("deepest"), *[F.sum(c).alias(c) for c in ("elements", "tables", "links")], F.sum(F.length("text")).alias("chars"),
    )


# The lines of a correction's first page.
TARGET = r"1\.\s*정정대상\s*공시서류[^\S\n]*[:：]?[ ]*([^\n]*?)(?=[ ]*2\.\s*정정대상|\n|$)"
FILED = r"최초\s*제출일\s*[:：]?[ ]*([^\n]{0,40})"
REASON = r"3\.\s*정정사유\s*[:：]?\s*([\s\S]*?)(?=\s*4\.\s*정정사항|$)"
DATE = r"(\d{4})\s*[년.\-/월]\s*(\d{1,2})\s*[년월.\-/]\s*(\d{1,2})(?:\s*일)?"
NEXT_ITEM = r"^[ ]*([2-4][ ]*[.．]|항[ ]*목)"
ITEM_HEAD, ITEM_REASON = "항목", "정정사유"


def correction_fields(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, target, filed_raw, filed_date, reason, items) of pages that tell what they correct.

    A value is what stands behind its words on their line, else the next line that isn't empty, unless that begins another
    item. Dates outside 1990 to 2099 or not in the calendar are null. Without a reason's line, the different reasons of the
    items' table are joined. items are the rows of the first table with a column of items.
    """
    lines = outline(pages, id_, html).groupBy(id_).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "title", "text"))), lambda x: F.concat_ws("\n", x["title"], x["text"])), "\n").alias("t"))
    lines = lines.where(C("t").rlike(TARGET) | C("t").rlike(FILED))

    def behind(pattern: str) -> Column:
        after = F.regexp_extract("t", f"(?:{pattern})" + r"[^\n]*\n\s*([^\n]*)", 2)
        after = F.when((F.trim(after) != "") & ~after.rlike(NEXT_ITEM), F.trim(after))
        return after

    here = F.nullif(F.trim(F.regexp_extract("t", TARGET, 1)), F.lit(""))
    d = lines.withColumn("target", F.coalesce(here, behind(TARGET)))
    own = F.regexp_extract("t", FILED, 1)
    following = behind(FILED)
    d = d.withColumn("filed_raw", F.when(own.rlike(DATE), F.regexp_extract(own, r"^([\s\S]*?" + DATE + ")", 1)).when(following.rlike(DATE), F.regexp_extract(following, r"^([\s\S]*?" + DATE + ")", 1)).otherwise(F.nullif(F.trim(own), F.lit(""))))
    part = lambda i: F.regexp_extract("filed_raw", DATE, i).try_cast("int")
    made = F.when(part(1).between(1990, 2099), F.concat_ws("-", part(1).cast("string"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0")).try_cast("date"))
    d = d.withColumn("filed_date", made).withColumn("reason", F.nullif(F.trim(F.regexp_replace(F.regexp_extract("t", REASON, 1), r"\s+", " ")), F.lit("")))
    rows = grids(pages, id_, html).withColumn("tight", F.transform("cells", lambda x: F.regexp_replace(x, r"\s", "")))
    heads = rows.where((C("row_no") == 0) & F.array_contains("tight", ITEM_HEAD)).groupBy(id_).agg(F.min_by(F.struct("table_no", C("tight").alias("names")), "table_no").alias("h"))
    items = rows.where("row_no > 0").join(heads, id_).where(C("table_no") == C("h.table_no"))
    n = F.least(F.size("h.names"), F.size("cells"))
    items = items.withColumn("m", F.map_from_arrays(F.slice("h.names", F.lit(1), n), F.slice("cells", F.lit(1), n)))
    items = items.groupBy(id_).agg(F.collect_list(F.struct("row_no", F.map_entries("m").alias("m"))).alias("items"))
    items = items.withColumn("items", F.transform(F.array_sort("items"), lambda x: F.map_from_entries(x["m"])))
    d = d.join(items, id_, "left").withColumn("items", F.coalesce("items", F.array().cast("array<map<string,string>>")))
    listed = F.array_join(F.array_distinct(F.filter(F.transform("items", lambda m: F.try_element_at(m, F.lit(ITEM_REASON))), lambda x: x.isNotNull() & (x != ""))), " | ")
    return d.select(id_, "target", "filed_raw", "filed_date", F.coalesce("reason", F.nullif(listed, F.lit(""))).alias("reason"), "items")


# ---- compressed blobs

CHART = "categories array<string>, close_price array<decimal(20,4)>, target_price array<decimal(20,4)>, select_item_name string, select_item array<decimal(20,4)>, item_name string, avg array<decimal(20,4)>, min_max array<array<decimal(20,4)>>"


@F.pandas_udf(T.StringType())
def inflate(bodies: pd.Series) -> pd.Series:
    """zlib-compressed UTF-8 as text; null where it is neither."""

    def one(body):
        try:
            return None if body is None else zlib.decompress(bytes(body)).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    return bodies.map(one)


inflate = inflate.asNondeterministic()  # a filter on what it gives must not open every body once more


@F.pandas_udf(T.BinaryType())
def deflate(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else zlib.compress(t.encode(), 1))


def charts(blobs: DataFrame, keys: list[str], body: str) -> tuple[DataFrame, DataFrame]:
    """(keys, chart, label, i, name, fields of CHART at that label) of all readable blobs, and (keys, reason) of the others.

    A blob is a compressed object whose members are objects, or texts that hold one.
    """
    d = blobs.withColumn("__text", inflate(body))
    d = d.withColumn("__outer", F.from_json("__text", "map<string,string>", {"mode": "PERMISSIVE"}))
    d = d.withColumn("__parts", F.transform(F.map_entries("__outer"), lambda x: F.struct(x["key"].alias("chart"), F.from_json(x["value"], CHART).alias("c"), x["value"].alias("raw"))))
    reason = F.when(C("__text").isNull(), "not_compressed_text").when(C("__outer").isNull(), "not_an_object").when(F.exists("__parts", lambda p: ~F.coalesce(p["raw"].rlike(r"^\s*\{"), F.lit(False))), "chart_not_an_object")
    d = d.withColumn("__reason", reason)
    rejects = d.where("__reason IS NOT NULL").select(*keys, C("__reason").alias("reason"))
    p = d.where("__reason IS NULL").select(*keys, F.explode("__parts").alias("p")).select(*keys, C("p.chart").alias("chart"), "p.c.*")
    p = p.select("*", F.posexplode("categories").alias("i", "label"))
    return p, rejects


def monthly_consensus(blobs: DataFrame, keys: list[str], endpoint: str, body: str, main: str, side: str) -> tuple[DataFrame, DataFrame]:
    """(keys, metric, label, value, close, target, lo, hi, seen), the two endpoints' charts outer-joined by metric and label,
    and (keys, endpoint, reason) of unreadable blobs.

    main gives value, close and target, side an average with its range. seen: both, main or side; one_empty where one of
    both has no value (main's stays, empty or not), mismatch where they differ; a label that a chart repeats with another
    value counts as repeated.
    """
    rejects = charts(blobs, [*keys, endpoint], body)[1]
    of = lambda name: charts(blobs.where(C(endpoint) == name), keys, body)[0]
    at = lambda c: F.get(C(c), C("i"))
    m = of(main).select(*keys, C("select_item_name").alias("metric"), "label", at("select_item").alias("value"), at("close_price").alias("close"), at("target_price").alias("target"))
    m = m.groupBy(*keys, "metric", "label").agg(F.min("value").alias("value"), F.max("value").alias("__top"), F.max("close").alias("close"), F.max("target").alias("target"))
    s = of(side).select(*keys, C("item_name").alias("metric"), "label", at("avg").alias("avg"), F.get(at("min_max"), F.lit(0)).alias("lo"), F.get(at("min_max"), F.lit(1)).alias("hi"))
    s = s.groupBy(*keys, "metric", "label").agg(F.min("avg").alias("avg"), F.max("avg").alias("__stop"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.lit(True).alias("__side"))
    j = m.withColumn("__main", F.lit(True)).join(s, [*keys, "metric", "label"], "full")
    seen = (
        F.when(C("__side").isNull(), "main").when(C("__main").isNull(), "side").when((C("value") != C("__top")) | (C("avg") != C("__stop")), "repeated")
        .when(C("value").isNull() != C("avg").isNull(), "one_empty").when(C("value") != C("avg"), "mismatch").otherwise("both")
    )
    return j.select(*keys, "metric", "label", F.when(C("__main").isNull(), C("avg")).otherwise(C("value")).alias("value"), "close", "target", "lo", "hi", seen.alias("seen")), rejects
