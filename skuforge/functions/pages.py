"""Reduces a web page to its text lines, tables and definition lists in one scan of its tags, with a stack of open elements.

Built-in expressions can't do this in time linear in a page's length: they have no stack that isn't copied at each step. The scan
is a small function on one page; Spark deals out the pages as Arrow batches. Every token is matched once, without going back, so
a page of unclosed tags, quotes or comments costs no more than any other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that are left out with all that is in them, and elements without an end tag.
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "noscript", "svg"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
# How tables and lists are marked in the text.
TABLE_MARK, LIST_MARK, CELL_MARK = "[TABLE on page 0]", "[SPEC LIST]", " | "

_TOKEN = re.compile(
    r"""<!--(?:[^-]++|-(?!->))*+(?:-->)?+"""  # comment
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"'=]++|=\s*+(?:"[^"]*+"?+|'[^']*+'?+)?+|["'])*+)>?+"""
    r"""|<[!?/][^>]*+>?+"""  # declaration and whatever else isn't text
    r"""|(?P<text>(?:[^<]++|<(?![a-zA-Z/!?]))++)"""
)
#: Of elements whose content isn't markup: where it ends.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in ("script", "style")}


class _Table:
    def __init__(self):
        self.rows: list[list[list[str]]] = []
        self.row: list[list[str]] | None = None
        self.cell: list[str] | None = None


class _List:
    def __init__(self):
        self.terms: list[list[str]] = []
        self.details: list[list[str]] = []
        self.item: list[str] | None = None


class _Page:
    """What has been read so far, and which elements are open."""

    def __init__(self):
        self.stack: list[str] = []
        self.count: dict[str, int] = {}
        self.dropped = 0
        self.lines: list[str] = []
        self.tables: list[_Table] = []
        self.lists: list[_List] = []
        self.open_tables: list[_Table] = []
        self.open_lists: list[_List] = []

    def open(self, name: str) -> None:
        if name in DROPPED:
            self.dropped += 1
        elif not self.dropped:
            self._open_structure(name)
        self.stack.append(name)
        self.count[name] = self.count.get(name, 0) + 1

    def _open_structure(self, name: str) -> None:
        if name == "table":
            self.tables.append(_Table())
            self.open_tables.append(self.tables[-1])
        elif name == "dl":
            self.lists.append(_List())
            self.open_lists.append(self.lists[-1])
        elif name == "tr" and self.open_tables:
            table = self.open_tables[-1]
            table.row, table.cell = [], None
            table.rows.append(table.row)
        elif name in ("td", "th") and self.open_tables:
            table = self.open_tables[-1]
            if table.row is None:
                table.row = []
                table.rows.append(table.row)
            table.cell = []
            table.row.append(table.cell)
        elif name in ("dt", "dd") and self.open_lists:
            inside = self.open_lists[-1]
            inside.item = []
            (inside.terms if name == "dt" else inside.details).append(inside.item)

    def close(self, name: str) -> None:
        """Ends the innermost element of the name and those inside it; an end tag without a beginning is nothing."""
        if not self.count.get(name):
            return
        while True:
            last = self.stack.pop()
            self.count[last] -= 1
            if last in DROPPED:
                self.dropped -= 1
            elif not self.dropped:
                self._close_structure(last)
            if last == name:
                return

    def _close_structure(self, name: str) -> None:
        if name == "table" and self.open_tables:
            self.open_tables.pop()
        elif name == "dl" and self.open_lists:
            self.open_lists.pop()
        elif name == "tr" and self.open_tables:
            self.open_tables[-1].row = self.open_tables[-1].cell = None
        elif name in ("td", "th") and self.open_tables:
            self.open_tables[-1].cell = None
        elif name in ("dt", "dd") and self.open_lists:
            self.open_lists[-1].item = None

    def text(self, raw: str) -> None:
        said = html.unescape(raw).strip()
        if not said or self.dropped:
            return
        self.lines.append(said)
        if self.open_tables and self.open_tables[-1].cell is not None:
            self.open_tables[-1].cell.append(said)
        if self.open_lists and self.open_lists[-1].item is not None:
            self.open_lists[-1].item.append(said)


def reduce_page(source: str) -> tuple[str, list[list[list[str]]], list[list[tuple[str, str]]]]:
    """(text, tables, lists of (term, detail)) of a page.

    Each piece of text between tags is a line, trimmed; character references are replaced; elements of DROPPED and comments go.
    A table counts with two rows or more that say something; after the lines come tables, then lists of pairs. A table inside a
    cell is a table of its own, and its text isn't repeated in the outer cell."""
    page, at = _Page(), 0
    while at < len(source):
        token = _TOKEN.match(source, at)
        at = token.end()
        if token["text"] is not None:
            page.text(token["text"])
        elif name := (token["name"] or "").lower():
            if token["end"]:
                page.close(name)
            elif name not in VOID and not (name == "svg" and token["rest"].endswith("/")):
                page.open(name)
                if name in _RAW_END:
                    end = _RAW_END[name].search(source, at)
                    at = end.start() if end else len(source)
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(page.lines))
    tables = [rows for t in page.tables if len(rows := [r for r in ([" ".join(c) for c in row] for row in t.rows) if any(r)]) >= 2]
    lists = [pairs for x in page.lists if (pairs := [(" ".join(a), " ".join(b)) for a, b in zip(x.terms, x.details, strict=False)])]
    said = ["\n" + "\n".join([TABLE_MARK, *(CELL_MARK.join(c.replace("\n", " ") for c in row) for row in rows)]) for rows in tables]
    said += ["\n" + "\n".join([LIST_MARK, *(CELL_MARK.join(p) for p in pairs)]) for pairs in lists]
    return body + "\n" + "\n".join(said), tables, lists


def reduce_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col, text, tables (rows of cells), pairs (lists of term and detail) of every whole page; see reduce_page(). A null page
    counts as empty: no text, no tables. One narrow pass; a task holds a page at a time."""
    given = pages.select(pages[f"`{id_col}`"].alias("id"), pages[f"`{html_col}`"].cast("string").alias("html"))
    pair = pa.list_(pa.list_(pa.struct([("term", pa.string()), ("detail", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                made = [reduce_page(x) if x else ("", [], []) for x in part.column(1).to_pylist()]
                lists = [[[{"term": a, "detail": b} for a, b in pairs] for pairs in m[2]] for m in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.list_(pa.list_(pa.string())))), pa.array(lists, pair)], ["id", "text", "tables", "pairs"])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, text string, tables array<array<array<string>>>, pairs array<array<struct<term: string, detail: string>>>").withColumnRenamed("id", id_col)
