"""Markup and office files to typed blocks, one document at a time inside Arrow tasks.

Parsing bytes is the one thing here that expressions can't do; joining, ordering, headings and tables' text are plans
over the block table that comes out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

BLOCKS = "block_order int, block_id string, block_type string, path string, text string, page int, cells array<struct<row:int,col:int,row_span:int,col_span:int,text:string,header:boolean>>"
_CELL = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("text", pa.string()), ("header", pa.bool_())]))
_KINDS = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), _CELL)
#: What is not content, and what gives a block.
SKIPPED = {"script", "style", "noscript", "template", "nav", "aside", "footer", "form"}
TYPES = {"h1": "TITLE", **{f"h{i}": "HEADING" for i in range(2, 7)}, "p": "PARAGRAPH", "li": "LIST_ITEM"}
#: Type of the rows that images give.
IMAGE = "IMAGE"
#: Type of the row that the text of a page without blocks gives.
ROOT_TEXT = "ROOT_TEXT"
#: Types of rows that are no blocks.
NO_BLOCKS = ("WARNING", IMAGE, ROOT_TEXT)
#: The most columns and rows that a cell may span, as in HTML; larger numbers count as these.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
                if node.tag in ("br", "p", "li", "td", "th", "div"):
                    out.append(" ")
        return squeeze("".join(out))


class _Tree(HTMLParser):
    """A forgiving tree: what is never closed ends with its parent; paragraphs and items end where the next begins."""

    CLOSES = {**{t: {"p"} for t in ("ul", "ol", "table", "div", "section", "article", "main", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")}, "p": {"p"}, "li": {"li", "p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}

    #: What is open beyond these stays open.
    ROOM = {"table", "td", "th", "caption", "button"}
    KEEP = {"li": {"ul", "ol", "table"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        shut, node = self.CLOSES.get(tag, ()), self.at
        while shut and node is not None and node.tag not in self.KEEP.get(tag, self.ROOM):
            if node.tag in shut:  # with all that is still open in it
                self.at = node.parent
            node = node.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _span(value: str | None, most: int) -> int:
    """A span attribute: its leading decimal digits, from 1 to ``most``; anything else is 1."""
    digits = re.match(r"\s*\+?([0-9]+)", value or "")
    return min(most, max(1, int(digits[1][:9]))) if digits else 1


def table_cells(table: _Node) -> list[dict]:
    """Cells at the logical columns that row and column spans leave free. Spans count up to ``MOST_COLUMNS`` and
    ``MOST_ROWS``."""
    free_from: dict[int, int] = {}  # the first row in which a column is free again
    cells, row = [], 0
    for tr in (n for n in table.walk() if n.tag == "tr"):
        col = 0
        for cell in (c for c in tr.walk() if c.tag in ("td", "th")):
            while free_from.get(col, 0) > row:
                col += 1
            down, across = _span(cell.attrs.get("rowspan"), MOST_ROWS), _span(cell.attrs.get("colspan"), MOST_COLUMNS)
            for c in range(col, col + across):
                free_from[c] = max(free_from.get(c, 0), row + down)
            cells.append({"row": row, "col": col, "row_span": down, "col_span": across, "text": cell.text(), "header": cell.tag == "th"})
            col += across
        row += 1
    return cells


def markdown(cells: list[dict]) -> str:
    """Rows as ``| a | b |``, without a separator row."""
    rows: dict[int, list[str]] = {}
    for c in cells:
        rows.setdefault(c["row"], []).append(c["text"])
    return "\n".join("| " + " | ".join(r) + " |" for _, r in sorted(rows.items()))


def html_blocks(raw: str) -> Iterator[tuple]:
    """Blocks of a page's main part in document order: headings, paragraphs, list items, tables, and captions of images
    that have one. Text inside tables is theirs alone; tables and images inside tables count. Before its caption each
    image gives a row of its own, which is no block. A page without blocks gives its whole text, which is none either."""
    tree = _Tree()
    tree.feed(raw)
    tree.close()
    for node in list(tree.root.walk()):
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in SKIPPED]
    root = next((n for n in tree.root.walk() if n.tag in ("main", "article")), None) or next((n for n in tree.root.walk() if n.tag == "body"), tree.root)
    order, in_table = 0, set()
    for node in root.walk():
        if id(node.parent) in in_table or (node.parent is not None and node.parent.tag == "table"):
            in_table.add(id(node))
        path = f"{node.tag}#{node.attrs['id']}" if (node.attrs.get("id") or "").strip() else f"{node.tag}[{order}]"
        kind, text, cells = TYPES.get(node.tag), "", []
        if node.tag == "table":
            kind, cells = "TABLE", table_cells(node)
            text = markdown(cells)
        elif node.tag == "img":
            kind, text = "IMAGE_CAPTION", squeeze(node.attrs.get("alt") or "")
            yield order, None, IMAGE, path, text, None, []
        elif kind and id(node) not in in_table:
            text = node.text()
        if text:
            yield order, f"b{order}", kind, path, text, None, cells
            order += 1
    if not order and (text := root.text()):
        yield 0, None, ROOT_TEXT, root.tag, text, None, []


def text_blocks(raw: str) -> Iterator[tuple]:
    """The paragraph that a plain text is."""
    if text := raw.strip():
        yield 0, "b0", "PARAGRAPH", "text", text, None, []


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _runs(node: ElementTree.Element) -> str:
    return squeeze("".join(n.text or "" for n in node.iter() if _local(n.tag) == "t"))


def _grid(table: ElementTree.Element, row_tag: str, cell_tag: str) -> list[dict]:
    return [
        {"row": r, "col": c, "row_span": 1, "col_span": 1, "text": _runs(cell), "header": False}
        for r, tr in enumerate(x for x in table.iter() if _local(x.tag) == row_tag)
        for c, cell in enumerate(x for x in tr if _local(x.tag) == cell_tag)
    ]


def _attr(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def docx_blocks(raw: bytes) -> Iterator[tuple]:
    """Blocks of a word-processing file: body, then headers, footers and footnotes."""
    order = 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = ["word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer|footnotes)\d*\.xml", n))]
        for part in parts:
            kind = {"h": "HEADER", "f": "FOOTER"}.get(part[5], None) if not part.startswith("word/footnotes") else "FOOTNOTE"
            root = ElementTree.fromstring(z.read(part))
            body = next((n for n in root.iter() if _local(n.tag) == "body"), root)
            inside = {id(p) for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter() if _local(p.tag) == "p"}
            for node in body.iter():
                name = _local(node.tag)
                if name == "tbl" and (cells := _grid(node, "tr", "tc")):
                    yield order, f"b{order}", "TABLE", f"{part}/tbl[{order}]", markdown(cells), None, cells
                    order += 1
                elif name == "p" and id(node) not in inside and (text := _runs(node)):
                    style = next((_attr(n, "val").lower() for n in node.iter() if _local(n.tag) == "pStyle"), "")
                    listed = any(_local(n.tag) == "numPr" for n in node.iter())
                    own = "LIST_ITEM" if listed else "TITLE" if "title" in style else "HEADING" if style.startswith("heading") else "PARAGRAPH"
                    yield order, f"b{order}", kind or own, f"{part}/p[{order}]", text, None, []
                    order += 1


def pptx_blocks(raw: bytes) -> Iterator[tuple]:
    """Blocks of a presentation: each slide's first text is its title, low shapes are footers."""
    order = 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        height = next((int(_attr(n, "cy") or 0) for n in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(n.tag) == "sldSz"), 6858000) if "ppt/presentation.xml" in z.namelist() else 6858000
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            titled = False
            for shape in (n for n in ElementTree.fromstring(z.read(name)).iter() if _local(n.tag) in ("sp", "graphicFrame")):
                if _local(shape.tag) == "graphicFrame":
                    if cells := _grid(shape, "tr", "tc"):
                        yield order, f"b{order}", "TABLE", f"slide[{number}]/tbl[{order}]", markdown(cells), number, cells
                        order += 1
                    continue
                top = next((int(_attr(n, "y") or 0) for n in shape.iter() if _local(n.tag) == "off"), 0)
                if text := _runs(shape):
                    kind = "FOOTER" if top > 0.8 * height else "PARAGRAPH" if titled else "TITLE"
                    titled = titled or kind == "TITLE"
                    yield order, f"b{order}", kind, f"slide[{number}]/sp[{order}]", text, number, []
                    order += 1


def hwpx_blocks(raw: bytes) -> Iterator[tuple]:
    """Paragraphs and tables of the sections of a zipped word-processing file."""
    order = 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
            root = ElementTree.fromstring(z.read(name))
            inside = {id(p) for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter() if _local(p.tag) == "p"}
            for node in root.iter():
                if _local(node.tag) == "tbl" and (cells := _grid(node, "tr", "tc")):
                    yield order, f"b{order}", "TABLE", f"{name}/tbl[{order}]", markdown(cells), None, cells
                    order += 1
                elif _local(node.tag) == "p" and id(node) not in inside and not any(_local(x.tag) == "tbl" for x in node.iter()) and (text := _runs(node)):
                    yield order, f"b{order}", "PARAGRAPH", f"{name}/p[{order}]", text, None, []
                    order += 1


PARSERS: dict[str, Callable] = {"HTML": html_blocks, "TEXT": text_blocks, "DOCX": docx_blocks, "PPTX": pptx_blocks, "HWPX": hwpx_blocks}
#: Parsers that read text rather than bytes.
OF_TEXT = {"HTML", "TEXT"}


def parsed(df: DataFrame, doc: str, content: str, fmt: str | Column = "HTML") -> DataFrame:
    """Blocks, images and warnings of all documents in one pass, told apart by ``block_type``.

    ``fmt`` is the format of all documents or a column of each one's (``files.file_format``): each goes to the parser
    of its format, and one whose format has none gives a warning. Null contents give nothing.
    """
    rows = df.select(doc, content, (F.lit(fmt) if isinstance(fmt, str) else fmt).alias("_format"))
    kind = rows.schema[doc].dataType.simpleString()
    names = [doc, "block_order", "block_id", "block_type", "path", "text", "page", "cells"]

    def warning(e: Exception) -> list[tuple]:
        return [(0, None, "WARNING", type(e).__name__, str(e).encode("utf-8", "replace").decode(), None, [])]

    def of_one(value, fmt: str) -> list[tuple]:
        """One document's rows; whatever a parser raises becomes its warning, and no other's."""
        if fmt not in PARSERS:
            return [(0, None, "WARNING", "UNSUPPORTED_FORMAT", fmt, None, [])]
        try:
            if isinstance(value, bytes) and fmt in OF_TEXT:
                value = value.decode("utf-8", "replace")
            return list(PARSERS[fmt](value))
        except Exception as e:  # noqa: BLE001
            return warning(e)

    def columns_of(made: list[list[tuple]]) -> list[pa.Array]:
        return [pa.array([o[c] for found in made for o in found], k) for c, k in enumerate(_KINDS)]

    def checked(found: list[tuple]) -> list[tuple]:
        try:
            columns_of([found])
        except Exception as e:  # noqa: BLE001
            return warning(e)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                rows = [row for row, ok in enumerate(part.column(1).is_valid().to_pylist()) if ok]
                made = [of_one(part.column(1)[row].as_py(), part.column(2)[row].as_py()) for row in rows]
                try:
                    columns = columns_of(made)
                except Exception:  # noqa: BLE001  one that Arrow can't hold: it becomes a warning
                    columns = columns_of(made := [checked(found) for found in made])
                at = [row for row, found in zip(rows, made, strict=True) for _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    # a small table is one file and few splits, however long its documents take: they are dealt to all tasks
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n).mapInArrow(run, f"{doc} {kind}, {BLOCKS}")


def blocks(df: DataFrame, doc: str, content: str, fmt: str | Column = "HTML") -> tuple[DataFrame, DataFrame]:
    """The blocks of all documents, and a warning (doc, code, message) for each that can't be parsed."""
    rows = parsed(df, doc, content, fmt)
    warnings = rows.where("block_type = 'WARNING'").select(doc, F.col("path").alias("code"), F.col("text").alias("message"))
    return rows.where(~F.col("block_type").isin(*NO_BLOCKS)), warnings


def images(df: DataFrame, doc: str, content: str, fmt: str | Column = "HTML") -> DataFrame:
    """The images of all documents: doc, source_ref and alt, which may be empty."""
    return parsed(df, doc, content, fmt).where(F.col("block_type") == IMAGE).select(doc, F.col("path").alias("source_ref"), F.col("text").alias("alt"))


def table_text(tables: DataFrame, key: list[str]) -> DataFrame:
    """Each table's rows as ``header: value`` pairs joined by `` | ``; header rows are the leading ones that have a
    header cell, and a column's header is what its header cells say, from top to bottom, each once.

    tables: key columns and cells.
    """
    flat = tables.select(*key, F.explode("cells").alias("c")).select(*key, "c.*")
    per_row = flat.groupBy(*key, "row").agg(F.max(F.col("header").cast("int")).alias("has_header"))
    w = Window.partitionBy(*key).orderBy("row")
    leading = per_row.withColumn("head", F.min("has_header").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).select(*key, "row", "head")
    marked = flat.join(leading, [*key, "row"])
    spread = marked.where("head").withColumn("at", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    heads = spread.groupBy(*key, F.col("at").alias("col")).agg(F.array_join(F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), lambda t: t != "")), " ").alias("title"))
    cells = marked.where("not head and text <> ''").join(heads, [*key, "col"], "left")
    said = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat("title", F.lit(": "), "text")).otherwise(F.col("text"))
    rows = cells.groupBy(*key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", said.alias("t")))), lambda x: x["t"]), " | ").alias("line"))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("vector_text"))


def carried_headings(found: DataFrame, doc: str) -> DataFrame:
    """Adds ``heading_path``: the last heading before each block, empty for blocks before any and for headings."""
    w = Window.partitionBy(doc).orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("block_type").isin("TITLE", "HEADING")
    last = F.last(F.when(heading, F.col("text")), ignorenulls=True).over(w)
    return found.withColumn("heading_path", F.when(heading, F.lit("")).otherwise(F.coalesce(last, F.lit(""))))


def plain_text(found: DataFrame, doc: str) -> DataFrame:
    """Each document's block texts by line. Of rows as ``parsed`` gives them, images and warnings don't count, and a
    page without blocks has its whole text."""
    found = found.where(~F.col("block_type").isin("WARNING", IMAGE)) if "block_type" in found.columns else found
    lines = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "text"))), lambda x: x["text"]), lambda t: tx.trimmed(t) != "")
    return found.groupBy(doc).agg(F.array_join(lines, "\n").alias("text"))


def normalised(blocks_: DataFrame, tables: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """Blocks, extracted tables and images of documents as one block table, in this order.

    blocks_: doc, block_order, block_id, block_type, text, source_ref, confidence. tables: doc, source_ref, text. images:
    doc, source_ref, caption, alt, ocr. A table block gives way to the extracted tables of its source, which have the
    heading and confidence of the first of its blocks; images have no heading; blank texts go.
    """
    headed = carried_headings(blocks_, doc)
    own = tables.select(doc, "source_ref").distinct().withColumn("_own", F.lit(True))
    left = headed.join(own, [doc, "source_ref"], "left").where("block_type <> 'TABLE' or _own is null").drop("_own")
    first = headed.where("block_type = 'TABLE'").groupBy(doc, "source_ref").agg(F.min(F.struct("block_order", "heading_path", "confidence")).alias("_b"))
    said = F.coalesce(*[F.nullif(tx.trimmed(F.col(c)), F.lit("")) for c in ("caption", "alt", "ocr")])
    none = F.lit(None)
    branches = [
        left.select(doc, F.lit(0).alias("_kind"), F.col("block_order").alias("_at"), "block_type", "text", "source_ref", "heading_path", "confidence"),
        tables.join(first, [doc, "source_ref"], "left").select(doc, F.lit(1).alias("_kind"), F.col("_b.block_order").alias("_at"), F.lit("TABLE").alias("block_type"), "text", "source_ref", F.coalesce("_b.heading_path", F.lit("")).alias("heading_path"), F.col("_b.confidence").alias("confidence")),
        images.select(doc, F.lit(2).alias("_kind"), none.cast("int").alias("_at"), F.lit("IMAGE_CAPTION").alias("block_type"), said.alias("text"), "source_ref", F.lit("").alias("heading_path"), none.cast("double").alias("confidence")),
    ]
    every = branches[0].unionByName(branches[1]).unionByName(branches[2]).where(tx.trimmed(F.col("text")) != "")
    order = F.row_number().over(Window.partitionBy(doc).orderBy("_kind", F.asc_nulls_last("_at"), "source_ref", "text")) - 1
    return every.withColumn("block_order", order.cast("int")).withColumn("block_id", F.concat(F.lit("n"), F.col("block_order").cast("string"))).drop("_kind", "_at")
