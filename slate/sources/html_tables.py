"""HTML table rows (S4): raw pages -> one row per table row.

The original downloaded monthly schedule pages and read the first ``<table>``
of each with a DataFrame reader.  Here the pages are a table
(``page_id, url, html``) and the parse runs on the executors through
``mapInPandas`` (Arrow batches), with the standard library's HTML parser.
This is the only Python step on executors; everything after it (date and
clock parsing, lookups, unpivot) is built-in expressions.

Each Arrow batch handed to Python is capped in bytes by
``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB by default) as well as in
rows, so a batch of large pages stays within a Python worker's memory; each
page is parsed on its own.

Header naming follows the usual table-reader conventions: the ``<thead>`` row
(or the first row of ``<th>`` cells) names the columns; a blank header becomes
``Unnamed: i``; a repeated header gets ``.1``, ``.2`` suffixes.  Pages without a
table produce no rows (the original skipped empty pages).
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_SCHEMA = "page_id long, url string, row_index int, cells map<string,string>"


class _FirstTable(HTMLParser):
    """Collect the rows of the ``index``-th top-level ``<table>`` of a page."""

    def __init__(self, index: int = 0) -> None:
        super().__init__(convert_charrefs=True)
        self.index = index
        self.seen = -1
        self.depth = 0          # nesting depth of tables while inside the target
        self.active = False
        self.done = False
        self.in_head = False
        self.rows: list[tuple[bool, bool, list[str]]] = []  # (in_thead, all_th, cells)
        self._row: list[tuple[str, int, int]] | None = None  # (text, colspan, rowspan)
        self._row_th: list[bool] = []
        self._cell: list[str] | None = None
        self._spans = (1, 1)
        self._below: dict[int, tuple[str, int]] = {}  # column -> (text, rows it still covers)

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            if self.active:
                self.depth += 1
                return
            self.seen += 1
            if self.seen == self.index:
                self.active = True
            return
        if not self.active or self.depth:
            return
        if tag in ("thead", "tbody", "tfoot"):
            self._close_row()
            self.in_head = tag == "thead"
        elif tag == "tr":  # end tags of rows and cells may be left out
            self._close_row()
            self._row, self._row_th = [], []
        elif tag in ("td", "th"):
            self._close_cell()
            if self._row is None:
                self._row, self._row_th = [], []
            self._cell = []
            given = dict(attrs)
            self._spans = _span(given.get("colspan")), _span(given.get("rowspan"))
            self._row_th.append(tag == "th")
        elif tag == "br" and self._cell is not None:
            self._cell.append(" ")

    def handle_endtag(self, tag):
        if not self.active or self.done:
            return
        if tag == "table":
            if self.depth:
                self.depth -= 1
            else:
                self._close_row()
                self.done = True
            return
        if self.depth:
            return
        if tag in ("td", "th"):
            self._close_cell()
        elif tag == "tr":
            self._close_row()
        elif tag in ("thead", "tbody", "tfoot"):
            self._close_row()
            self.in_head = False

    def handle_data(self, data):
        if self.active and not self.depth and self._cell is not None:
            self._cell.append(data)

    def _close_cell(self):
        if self._cell is not None and self._row is not None:
            self._row.append((" ".join("".join(self._cell).split()), *self._spans))
        self._cell = None

    def _close_row(self):
        """Lay the row's cells into columns, around cells that reach down from rows above."""
        self._close_cell()
        if self._row:
            cells: list[str] = []
            below: dict[int, tuple[str, int]] = {}

            def from_above():
                while len(cells) in self._below:
                    text, left = self._below[len(cells)]
                    if left > 1:
                        below[len(cells)] = (text, left - 1)
                    cells.append(text)

            for text, columns, rows in self._row:
                from_above()
                for _ in range(columns):
                    if rows > 1:
                        below[len(cells)] = (text, rows - 1)
                    cells.append(text)
            from_above()
            self._below = below
            self.rows.append((self.in_head, all(self._row_th), cells))
        self._row = None


def _span(value: str | None) -> int:
    """A colspan or rowspan; anything but a positive number counts as 1 (as browsers do, up to 1000)."""
    return min(max(int(value), 1), 1000) if value and value.strip().isdigit() else 1


def _column_names(header: list[str]) -> list[str]:
    names, seen = [], {}
    for i, h in enumerate(header):
        base = h if h else f"Unnamed: {i}"
        n = seen.get(base, 0)
        names.append(base if n == 0 else f"{base}.{n}")
        seen[base] = n + 1
    return names


def parse_table(html: str | None, index: int = 0) -> list[dict[str, str]]:
    """Rows of the ``index``-th table of one page as ``{header: cell}`` dicts."""
    if not html:
        return []
    p = _FirstTable(index)
    p.feed(html)
    p.close()
    if not p.rows:
        return []
    head_at = next((i for i, (in_head, _, _) in enumerate(p.rows) if in_head), None)
    if head_at is None:
        head_at = next((i for i, (_, all_th, _) in enumerate(p.rows) if all_th), 0)
    header = _column_names(p.rows[head_at][2])
    out = []
    for in_head, _, cells in p.rows[head_at + 1:]:
        if in_head:
            continue
        out.append({header[j]: cells[j] for j in range(min(len(header), len(cells)))})
    return out


def _parse_batches(index: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, urls, nums, cells = [], [], [], []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                for k, row in enumerate(parse_table(html, index)):
                    ids.append(pid)
                    urls.append(url)
                    nums.append(k)
                    cells.append(row)
            yield pd.DataFrame({"page_id": pd.Series(ids, dtype="int64"), "url": pd.Series(urls, dtype=object),
                                "row_index": pd.Series(nums, dtype="int32"), "cells": pd.Series(cells, dtype=object)})
    return run


def html_table_rows(pages: DataFrame, table_index: int = 0) -> DataFrame:
    """S4 + U1: every row of the ``table_index``-th table of every page.

    Output ``(page_id, url, row_index, cells map<header, text>)``; the union of
    the pages is implicit (one distributed frame).  Pages without a ``<table``
    tag are dropped by a JVM-side filter first, so they never cross to Python.
    """
    has_table = F.lower(F.col("html")).contains("<table")
    return (pages.select("page_id", "url", "html").where(has_table)
            .mapInPandas(_parse_batches(table_index), ROW_SCHEMA))
