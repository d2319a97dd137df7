"""Text and HTML into columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_text(df: DataFrame, columns: list[str], strip_tags: bool = False) -> DataFrame:
    """NFKC, one space for runs of white space, no spaces at the ends; each batch converts its distinct values once."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map({v: unicodedata.normalize("NFKC", v) for v in s.dropna().unique()})

    for c in columns:
        x = F.regexp_replace(c, "<[^>]*>", " ") if strip_tags else F.col(c)
        df = df.withColumn(c, F.trim(F.regexp_replace(nfkc(x), r"\s+", " ")))
    return df


class _Marks(HTMLParser):
    """What a page consists of, in order: (what, value), with what one of begin, end, text."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.seen.append(("begin", tag))
        self.handle_endtag = lambda tag: self.seen.append(("end", tag))
        self.handle_data = lambda data: self.seen.append(("text", data))
        self.feed(page)
        self.close()


def table_rows(page: str) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of a page in the order of its tables; a nested table's cells are its own, as is text before the next cell."""
    grids: dict[int, list[list[str]]] = {}
    inside: list[int] = []  # numbers of the tables around
    text: list[str] | None = None  # of the cell that is open
    for what, value in _Marks(page).seen:
        if what == "text":
            if text is not None:
                text.append(value)
            continue
        if value not in ("table", "tr", "td", "th"):
            continue
        if text is not None and inside and grids[inside[-1]]:
            grids[inside[-1]][-1].append(" ".join("".join(text).split()))
        text = None
        if value == "table" and what == "begin":
            inside.append(len(grids))
            grids[inside[-1]] = []
        elif value == "table":
            inside = inside[:-1]
        elif what == "begin" and inside:
            if value == "tr":
                grids[inside[-1]].append([])
            else:
                text = []
    return [(t, r, cells) for t, grid in grids.items() for r, cells in enumerate(grid)]


def html_tables(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, table_no, row_no, cells) for every row of every table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, h in zip(b["id"], b["html"], strict=True):
                out += [(i, *row) for row in table_rows(h or "")]
            yield pd.DataFrame(out, columns=["id", "table_no", "row_no", "cells"])

    kind = pages.schema[id_].dataType.simpleString()
    d = pages.select(F.col(id_).alias("id"), F.col(html).alias("html"))
    return d.mapInPandas(run, f"id {kind}, table_no int, row_no int, cells array<string>").withColumnRenamed("id", id_)


class _Sections(HTMLParser):
    """Titles with the text that follows each."""

    HEADS = {"h1", "h2", "h3", "title"}
    SKIP = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[tuple[str, list[str], list[str]]] = [("", [], [])]
        self.inside: str | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.HEADS:
            self.inside = tag
            self.sections.append((tag, [], []))

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag == self.inside:
            self.inside = None

    def handle_data(self, data):
        if not self.skip:
            self.sections[-1][1 if self.inside else 2].append(data)


def doc_sections(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, section_no, level, title, text): a page's headings in order, each with the text up to the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = lambda x: " ".join(" ".join(x).split())
        for b in batches:
            out = []
            for i, h in zip(b["id"], b["html"], strict=True):
                p = _Sections()
                p.feed(h or "")
                p.close()
                out += [(i, n, level, fold(title), fold(text)) for n, (level, title, text) in enumerate(p.sections)]
            yield pd.DataFrame(out, columns=["id", "section_no", "level", "title", "text"])

    kind = pages.schema[id_].dataType.simpleString()
    d = pages.select(F.col(id_).alias("id"), F.col(html).alias("html"))
    return d.mapInPandas(run, f"id {kind}, section_no int, level string, title string, text string").withColumnRenamed("id", id_)


@F.pandas_udf(T.StringType())
def cp949(contents: pd.Series) -> pd.Series:
    """Spark itself decodes Unicode and Latin only. Bytes that are no character become the replacement character."""
    return contents.map(lambda b: None if b is None else bytes(b).decode("cp949", "replace"))


def doc_text(df: DataFrame, content: str, out: str = "text") -> DataFrame:
    """Text of HTML bytes: UTF-8 where valid, else CP949; scripts, styles, comments and tags go, white space is folded."""
    utf8 = F.try_validate_utf8(F.col(content).cast("string"))
    s = F.coalesce(utf8, cp949(F.when(utf8.isNull(), F.col(content))))
    s = F.regexp_replace(s, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return df.withColumn(out, F.trim(F.regexp_replace(s, r"\s+", " ")))
