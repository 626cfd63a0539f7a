"""HTML pages as a tree of layout items: headings, lists, tables, running furniture.

One Arrow stage folds each page's tags with the stack machine of ``sheaf.functions.markup``.
``div``, ``section`` and ``span`` have no meaning of their own.  What lies in ``nav``, ``aside``,
in a page's ``header`` or ``footer``, or in an element whose ARIA role says so is furniture.  A
table that arranges a page (with headings or further tables in it, of one cell, or so declared)
is no table.  All text outside scripts and styles lies in an item or in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.markup import HEADINGS, Page, parse
from sheaf.operators.layout import table_text

CELL = "struct<text:string,column_header:boolean>"
SCHEMA = f"paper_id string, pos int, parent_pos int, label string, text string, level int, depth int, headings array<string>, captions array<string>, grid array<array<{CELL}>>"

# What elements are as layout items, where they are more than text.
LABELS = {"title": "TITLE", "h1": "SECTION_HEADER", "h2": "SECTION_HEADER", "h3": "SECTION_HEADER", "h4": "SECTION_HEADER", "h5": "SECTION_HEADER", "h6": "SECTION_HEADER", "pre": "CODE", "li": "LIST_ITEM", "caption": "CAPTION", "figcaption": "CAPTION"}
LISTS = ("ul", "ol", "menu", "dir")
# Roles of furniture, and the elements that have them.
FURNITURE_ROLES = {"navigation": "PAGE_HEADER", "banner": "PAGE_HEADER", "complementary": "PAGE_HEADER", "search": "PAGE_HEADER", "contentinfo": "PAGE_FOOTER"}
FURNITURE_TAGS = {"nav": "PAGE_HEADER", "aside": "PAGE_HEADER", "search": "PAGE_HEADER", "header": "PAGE_HEADER", "footer": "PAGE_FOOTER"}
SECTIONING = ("article", "main", "section")
#: Columns and rows that a cell can span.
MOST_COLUMNS, MOST_ROWS = 1000, 1000


class _Tree:
    """The items of one page."""

    def __init__(self, page: Page):
        self.page, self.elements = page, page.elements
        self.kind, self.table = [None] * len(page.elements), [-1] * len(page.elements)
        headed, arranged = self._headed(), self._arranged()
        inside = [False] * len(page.elements)
        for n, e in enumerate(page.elements[1:], 1):
            above = e.parent
            inside[n] = inside[above] or e.tag in SECTIONING
            role = e.attributes.get("role", "").lower() if "role" in e.written.lower() else ""
            # a header or footer of an article is none of the page, and the headline's block is no running header
            own = FURNITURE_ROLES.get(role) or (FURNITURE_TAGS.get(e.tag) if e.tag not in ("header", "footer") or not inside[above] and (e.tag == "footer" or n not in headed) else None)
            self.kind[n] = self.kind[above] or own
            self.table[n] = n if e.tag == "table" and n not in arranged else self.table[above]
        self.rows: list[dict] = []
        self.groups: dict[int, int] = {}
        self.cells: dict[int, dict[int, list[str]]] = {}
        self.path: list[tuple[int, str]] = []

    def _headed(self) -> set[int]:
        return {a for n, e in enumerate(self.elements) if e.tag == "h1" for a in self.page.above(n)}

    def _arranged(self) -> set[int]:
        """Tables that arrange a page."""
        cells: dict[int, int] = {}
        found = {n for n, e in enumerate(self.elements) if e.tag == "table" and e.attributes.get("role", "").lower() in ("presentation", "none")}
        for n, e in enumerate(self.elements):
            if e.tag in HEADINGS or e.tag in ("table", "td", "th"):
                holder = next((a for a in self.page.above(e.parent) if self.elements[a].tag == "table"), None)
                if holder is None:
                    continue
                if e.tag in ("td", "th"):
                    cells[holder] = cells.get(holder, 0) + 1
                else:
                    found.update(a for a in self.page.above(holder) if self.elements[a].tag == "table")
        return found | {n for n, e in enumerate(self.elements) if e.tag == "table" and cells.get(n, 0) < 2}

    def add(self, label: str, text: str, parent: int | None, depth: int = 0, level: int | None = None, furniture: bool = False) -> int:
        self.rows.append({"pos": len(self.rows), "parent_pos": parent, "label": label, "text": text, "level": level, "depth": depth, "headings": [] if furniture else [h for _, h in self.path], "captions": None, "grid": None})
        return len(self.rows) - 1

    def group(self, number: int) -> tuple[int | None, int]:
        """The place of the innermost list or table around an element, made where it is new, and how many lists are around it."""
        chain = [a for a in self.page.above(number) if self.elements[a].tag in LISTS or self.table[a] == a]
        parent, depth = None, 0
        for a in reversed(chain):
            if a not in self.groups:
                label = "TABLE" if self.table[a] == a else "LIST"
                self.groups[a] = self.add(label, "", parent, depth + (label == "LIST"), furniture=self.kind[a] is not None)
            parent = self.groups[a]
            depth += self.elements[a].tag in LISTS
        return parent, depth

    def run(self) -> list[dict]:
        for r in self.page.runs:
            chain = list(self.page.above(r.owner))
            parent, depth = self.group(r.owner)
            table, furniture = self.table[r.owner], self.kind[r.owner]
            if table >= 0:
                cell = next((a for a in chain[: chain.index(table)] if self.elements[a].tag in ("td", "th")), None)
                if cell is not None:
                    self.cells.setdefault(table, {}).setdefault(cell, []).append(r.text)
                    continue
            tags = [self.elements[a].tag for a in chain]
            # a paragraph in a heading that was not closed is none
            plain = "p" in tags
            tag = next((t for i, t in enumerate(tags) if t in LABELS and not (t in HEADINGS and plain and "p" in tags[:i])), "")
            label = furniture or LABELS.get(tag, "TEXT")
            level = int(tag[1]) if label == "SECTION_HEADER" else None
            if level:
                self.path = [h for h in self.path if h[0] < level]
            at = self.add(label, r.text, parent, depth, level, furniture is not None)
            if level:
                self.path.append((level, r.text))
            if table >= 0 and tag == "caption":
                place = self.groups[table]
                self.rows[place]["captions"] = [*(self.rows[place]["captions"] or []), self.rows[at]["text"]]
        for table, place in self.groups.items():
            if self.table[table] == table:
                self.rows[place]["captions"] = self.rows[place]["captions"] or []
                self.rows[place]["grid"] = self.grid(table)
        return self.rows

    def grid(self, table: int) -> list[list[dict]]:
        """The table's cells by row and column; a cell that spans several stands in each."""
        lines = [n for n, e in enumerate(self.elements) if e.tag == "tr" and self.table[n] == table]
        cells: dict[int, list[int]] = {n: [] for n in lines}
        for n, e in enumerate(self.elements):
            if e.tag in ("td", "th") and self.table[n] == table and e.parent in cells:
                cells[e.parent].append(n)
        out: list[dict[int, dict]] = [{} for _ in lines]
        for i, line in enumerate(lines):
            heading = any(self.elements[a].tag == "thead" for a in self.page.above(line))
            column = 0
            for n in cells[line]:
                while column in out[i]:
                    column += 1
                e = self.elements[n]
                value = {"text": " ".join(self.cells.get(table, {}).get(n, [])), "column_header": heading or (e.tag == "th" and (i == 0 or e.attributes.get("scope", "").lower() == "col"))}
                for down in range(min(span(e.attributes.get("rowspan"), MOST_ROWS), len(lines) - i)):
                    for right in range(span(e.attributes.get("colspan"), MOST_COLUMNS)):
                        out[i + down].setdefault(column + right, value)
                column += 1
        blank = {"text": "", "column_header": False}
        width = max((max(line, default=-1) + 1 for line in out), default=0)
        return [[line.get(c, blank) for c in range(width)] for line in out]


def span(written: str | None, most: int) -> int:
    return min(int(written), most) if written and written.isascii() and written.isdigit() and int(written) > 0 else 1


def nodes(pages: DataFrame) -> DataFrame:
    """The tree of each page (page_id, html): items, lists and tables in page order, each with its parent's pos.

    ``depth``: how many lists are around it; ``headings``: those that it stands under, the
    outermost first; ``captions`` and ``grid`` of tables, which have no text of their own.
    """
    types = {"paper_id": pa.string(), "pos": pa.int32(), "parent_pos": pa.int32(), "label": pa.string(), "text": pa.string(), "level": pa.int32(), "depth": pa.int32(), "headings": pa.list_(pa.string()), "captions": pa.list_(pa.string())}
    cell = pa.struct([("text", pa.string()), ("column_header", pa.bool_())])
    schema = pa.schema([*types.items(), ("grid", pa.list_(pa.list_(cell)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, html in zip(batch.column("paper_id").to_pylist(), batch.column("html"), strict=True):
                found = _Tree(parse(html.as_py())).run()
                if found:
                    yield pa.RecordBatch.from_pylist([{"paper_id": name, **row} for row in found], schema)

    return pages.select(F.col("page_id").cast("string").alias("paper_id"), "html").mapInArrow(merged(run, schema), SCHEMA)


def merged(run, schema: pa.Schema, rows: int = 4096):
    """Batches of one page each put together to larger ones."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return over


def tables(tree: DataFrame) -> DataFrame:
    """paper_id, pos, captions, grid of the tables of a tree."""
    return tree.where("grid is not null").select("paper_id", "pos", "captions", "grid")


def items(tree: DataFrame) -> DataFrame:
    """What has text, in order: paper_id, pos, label, text, level, depth, headings; a table's text are its rows."""
    text = F.when(F.col("grid").isNotNull(), table_text(F.col("grid"))).otherwise(F.col("text"))
    return tree.withColumn("text", text).where("text != ''").select("paper_id", "pos", "label", "text", "level", "depth", "headings")
