"""HTML pages to table cells, links and texts: each page is read once, with a stack of its open tables.

A new row or cell ends the one before it, so unclosed ``<tr>`` and ``<td>`` read the same as closed ones. Tags belong to the
innermost open table; the text, forms and links of a table inside a cell count for that cell as well. Comments, scripts and styles
are left out. All HTML 5 character references are decoded, those without a semicolon too.

Pages are read by ``mapInArrow``: a filter on what was read is never pushed below the reader, which would read pages twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

CELL = "struct<text: string, has_form: boolean, href: string>"
PARTS = {
    "tables": f"array<struct<attributes: string, rows: array<array<{CELL}>>>>",
    "links": f"array<{CELL}>",
    "texts": "array<string>",
}
# Text, then what ends it: a comment, a script or style, a tag (with its end as the fifth group), or the rest of a page that holds no tag any more.
# Only names of scripts and styles are matched in either case here, as that costs most of a match.
_MARKUP = re.compile(
    r"([^<]*)(?:<(?:!--.*?-->|((?i:script|style))\b.*?</(?i:\2)\s*>|(/?)([a-zA-Z][a-zA-Z0-9]*)?([^>]*)(>))|(.*)\Z)", re.S
)
_KNOWN = frozenset("a table tr td th form".split())
_HREF = re.compile(r"href\s*=\s*[\"']([^\"']*)", re.I)


class _Fragment:
    """What a cell or a link holds."""

    __slots__ = ("parts", "has_form", "href")

    def __init__(self):
        self.parts, self.has_form, self.href = [], False, None

    def cell(self) -> tuple:
        """(text, has_form, href)"""
        return decoded("".join(self.parts)).strip(), self.has_form, self.href or None


class _Table:
    """An open table: its rows, and the row and the cell that are open."""

    __slots__ = ("attributes", "rows", "row", "cell")

    def __init__(self, attributes: str):
        self.attributes, self.rows, self.row, self.cell = attributes, [], None, None

    def end_cell(self):
        if self.cell is not None:
            self.row.append(self.cell.cell())
            self.cell = None

    def end_row(self):
        self.end_cell()
        if self.row:
            self.rows.append(self.row)
        self.row = None


def decoded(text: str) -> str:
    """Character references to characters; a no-break space becomes a space."""
    return unescape(text).replace("\xa0", " ") if "&" in text else text.replace("\xa0", " ")


def read_page(html: str, with_texts: bool = True) -> dict[str, list]:
    """Tables in page order (nested ones too), links, and text nodes of one page."""
    tables: list[_Table] = []
    open_: list[_Table] = []
    links: list[tuple] = []
    texts: list[str] = []
    link = None
    pending = ""

    def fragments() -> list[_Fragment]:
        found = [table.cell for table in open_ if table.cell is not None]
        return found if link is None else [link, *found]

    def told(node: str):
        if with_texts:
            texts.append(node)
        for f in fragments():
            f.parts.append(node)

    for text, _, closes, name, attributes, end, rest in _MARKUP.findall(html):
        if text or rest:
            pending += text + rest
        if not end:
            continue
        if pending:
            node = pending.strip()
            pending = ""
            if node:
                told(node)
        name = name.lower()
        if name in _KNOWN:
            top = open_[-1] if open_ else None
            if name == "a" and not closes and link is None:
                link = _Fragment()
            elif name == "table":
                if not closes:
                    tables.append(_Table(attributes))
                    open_.append(tables[-1])
                elif top:
                    top.end_row()
                    open_.pop()
            elif top and name == "tr":
                top.end_row()
                if not closes:
                    top.row = []
            elif top and name in ("td", "th") and top.row is not None:
                top.end_cell()
                if not closes:
                    top.cell = _Fragment()
        if not closes and (name == "form" or (attributes and "href" in attributes.lower())):
            href = _HREF.search(attributes)
            for f in fragments():
                f.has_form = f.has_form or name == "form"
                if href and f.href is None:
                    f.href = href.group(1)
        if closes and name == "a" and link is not None:
            links.append(link.cell())
            link = None
    node = pending.strip()
    if node:
        told(node)
    for table in reversed(open_):
        table.end_row()
    if link is not None:
        links.append(link.cell())
    return {"tables": tables, "links": links, "texts": [decoded(t).strip() for t in texts]}


def _nested(lists: list, values) -> pa.Array:
    """A list column from its lists (None: NULL) and what makes a column of all their items."""
    offsets, items, end = [], [], 0
    for found in lists:
        offsets.append(None if found is None else end)
        if found is not None:
            items.extend(found)
            end = len(items)
    return pa.ListArray.from_arrays(pa.array([*offsets, end], pa.int32()), values(items))


def _cells_column(cells: list[tuple]) -> pa.Array:
    text, has_form, href = zip(*cells) if cells else ((), (), ())
    columns = [pa.array(text, pa.string()), pa.array(has_form, pa.bool_()), pa.array(href, pa.string())]
    return pa.StructArray.from_arrays(columns, ["text", "has_form", "href"])


def _tables_column(tables: list[_Table]) -> pa.Array:
    rows = _nested([t.rows for t in tables], lambda rows: _nested(rows, _cells_column))
    return pa.StructArray.from_arrays([pa.array([t.attributes for t in tables], pa.string()), rows], ["attributes", "rows"])


# A part's column is built from flat columns, not from nested objects.
_COLUMNS = {"tables": _tables_column, "links": _cells_column, "texts": lambda texts: pa.array(texts, pa.string())}


def _reader(parts: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if h is None else read_page(h, "texts" in parts) for h in batch.column(1).to_pylist()]
            columns = [_nested([f and f[p] for f in found], _COLUMNS[p]).cast(k) for p, k in zip(parts, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_key", *parts])

    return run


def read_pages(pages: DataFrame, key: str, html: str = "html", parts: str = "tables") -> DataFrame:
    """``key`` and parts of each page, out of ``tables``, ``links`` and ``texts``; NULL for a NULL page."""
    names = parts.split()
    kinds = StructType.fromDDL(", ".join(f"{p} {PARTS[p]}" for p in names)).fields
    schema = StructType([StructField("_key", pages.schema[key].dataType), *kinds])
    rows = pages.select(F.col(key).alias("_key"), F.col(html).cast("string").alias("_html"))
    return rows.mapInArrow(_reader(names, [to_arrow_type(k.dataType) for k in kinds]), schema).withColumnRenamed("_key", key)


def grids(tables: Column) -> Column:
    """The tables' rows of cells; rows without cells are left out."""
    return F.transform(tables, lambda t: t["rows"])


def cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Long table of cells: key, table, row and column index from 0, text, form flag and link."""
    t = read_pages(pages, key, html).select(key, F.posexplode("tables").alias("table_idx", "_t"))
    r = t.select(key, "table_idx", F.posexplode("_t.rows").alias("row_idx", "_r"))
    return r.select(key, "table_idx", "row_idx", F.posexplode("_r").alias("col_idx", "_c")).select(
        key, "table_idx", "row_idx", "col_idx", "_c.*"
    )


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per anchor: key, text, form flag and link."""
    return read_pages(pages, key, html, "links").select(key, F.explode("links").alias("_c")).select(key, "_c.*")
