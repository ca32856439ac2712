"""Chunkers: tables of documents to tables of chunks.

Fixed windows and structure are plans of built-in functions. Recursive and overlap packing are greedy in the order of
the text; there a small function per document runs inside Arrow tasks, one document at a time. Ids, counts and links
are added by expressions, without an exchange.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

#: Sentence ends: a documented stand-in for locale-aware boundaries.
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
#: In the order they are tried.
BREAKS = (re.compile(r"\n[ \t\n\x0b\f\r]*\n"), re.compile(r"\n"), SENTENCE, re.compile(r"[ \t\n\x0b\f\r]+"))
PARAGRAPHS = BREAKS[0]
_TRIM = tx.LOW
#: Windows that are cut from one part of a long text.
BLOCK = 256


@dataclass(frozen=True)
class Sizes:
    """Largest size, overlap and unit of chunks; what isn't sensible becomes the default or the nearest sensible."""

    max_size: int = 800
    overlap: int = 100
    unit: str = "character"

    def __post_init__(self):
        object.__setattr__(self, "max_size", self.max_size if self.max_size > 0 else 800)
        object.__setattr__(self, "overlap", min(self.overlap if self.overlap >= 0 else 100, self.max_size - 1))
        if self.unit not in ("character", "token"):
            raise ValueError(f"no such unit: {self.unit}")

    @property
    def most(self) -> int:
        """The largest weight of a chunk."""
        return 4 * self.max_size if self.unit == "token" else self.max_size

    def weight(self, text: str) -> int:
        """Characters that count: all, but in token units of the squeezed text, four a token; blank texts have none.
        A space between two texts that begin and end in others adds one."""
        if self.unit == "character":
            return len(text) if text.strip(_TRIM) else 0
        return len(re.sub(tx.ASCII_SPACE, " ", text).strip(_TRIM))


def with_ids(chunks: DataFrame, doc: str, strategy: str) -> DataFrame:
    """Adds chunk ids, counts, hash and links to (doc, chunk_order, last, content). A document's chunks are made in one
    place and in order, so its links follow from the order alone and nothing is moved; ``last`` goes."""
    named = lambda by: tx.chunk_id(F.col(doc).cast("string"), F.col("chunk_order") + by)
    return chunks.withColumns({
        "chunk_id": named(0),
        "prev_chunk_id": F.when(F.col("chunk_order") > 0, named(-1)),
        "next_chunk_id": F.when(~F.col("last"), named(1)),
        "char_count": F.length("content"),
        "token_count": tx.token_estimate(F.col("content")),
        "content_hash": tx.content_hash(F.col("content")),
        "strategy": F.lit(strategy),
    }).drop("last")


def fixed(df: DataFrame, doc: str = "doc_id", text: str = "text", sizes: Sizes = Sizes(), links: bool = True) -> DataFrame:
    """Windows of a fixed size. Offsets are those of the untrimmed windows; blank windows are skipped and don't count.

    A text's windows are counted from its length and cut where they are numbered, in one generated loop that holds the
    text once; long texts are cut into blocks of windows first, so that no window is sought from a long text's start.
    The generators are outer ones: for others the optimiser adds a filter that makes the text a second time.
    """
    size, overlap = tx.window_chars(sizes.max_size, sizes.unit), tx.window_chars(sizes.overlap, sizes.unit) if sizes.overlap else 0
    step = max(1, size - overlap)
    source = tx.trimmed(tx.unix_lines(F.coalesce(F.col(text), F.lit(""))))
    whole = df.select(F.col(doc), source.alias("_t"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    count = F.when(F.length("_t") > 0, F.greatest(F.lit(1), F.ceil((F.length("_t") - overlap) / step).cast("int"))).otherwise(0)
    # a blank window is one of blanks only, as the text's ends are none; where there can't be any, none is looked for
    window = lambda i: F.substring("_t", i * step + 1, F.lit(size))
    blank = F.when(F.col("_t").rlike(rf"[\x00-\x20]{{{size}}}"), F.filter(numbers(count), lambda i: tx.trimmed(window(i)) == ""))
    counted = whole.select(doc, "_t", count.alias("_n"), blank.alias("_blank"))
    blocks = counted.select(doc, "_t", "_n", "_blank", F.explode_outer(numbers(F.ceil(F.col("_n") / BLOCK).cast("int"))).alias("_b")).where("_b is not null")
    blocks = blocks.select(doc, "_n", "_blank", "_b", F.substring("_t", F.col("_b") * (BLOCK * step) + 1, F.lit(BLOCK * step + overlap)).alias("_s"))
    inside = F.least(F.col("_n") - F.col("_b") * BLOCK, F.lit(BLOCK))
    cut = blocks.select(doc, "_n", "_blank", "_b", "_s", F.explode_outer(numbers(inside)).alias("_w")).where("_w is not null")
    at = F.col("_b") * BLOCK + F.col("_w")
    gone = lambda test: F.coalesce(F.size(F.filter("_blank", test)), F.lit(0))
    own = F.substring("_s", F.col("_w") * step + 1, F.lit(size))
    placed = cut.where(F.col("_blank").isNull() | ~F.array_contains(F.coalesce("_blank", F.array().cast("array<int>")), at)).select(
        doc,
        (at * step).cast("int").alias("start_offset"),
        own.alias("_own"),
        F.when(F.col("_blank").isNull(), at).otherwise(at - gone(lambda i: i < at)).cast("int").alias("chunk_order"),
        (at == F.col("_n") - 1).alias("last"),
    )
    ordered = placed.select(doc, "start_offset", (F.col("start_offset") + F.length("_own")).cast("int").alias("end_offset"), tx.trimmed(F.col("_own")).alias("content"), "chunk_order", "last")
    return with_ids(ordered, doc, "fixed-size") if links else ordered.drop("last")


def pieces(text: str, sizes: Sizes) -> Iterator[tuple[str, int]]:
    """Parts of a text of at most the largest size, by the first kind of break that parts it, again and again, each
    with its weight (``Sizes.weight``)."""
    stack = [text]
    while stack:
        part = stack.pop()
        weight = sizes.weight(part)
        if weight <= sizes.most:
            yield part, weight
            continue
        for pattern in BREAKS:
            inner = [p for p in (x.strip(_TRIM) for x in pattern.split(part)) if p]
            if len(inner) > 1:
                stack.extend(reversed(inner))
                break
        else:
            window = tx.window_chars(sizes.max_size, sizes.unit)
            cuts = (part[i : i + window].strip(_TRIM) for i in range(0, len(part), window))
            yield from ((c, sizes.weight(c)) for c in cuts)


def recursive_chunks(text: str, sizes: Sizes) -> Iterator[tuple[int, str]]:
    """(virtual start, content) of chunks filled with pieces, a space between. A chunk begins with the tail of the one
    before, unless its first piece doesn't fit behind it. Weights add up, so no text is measured twice."""
    carried = tx.window_chars(sizes.overlap, sizes.unit) if sizes.overlap else 0
    found = [(p, w) for p, w in pieces(text, sizes) if w]
    start, at, tail = 0, 0, ""
    while at < len(found):
        head = sizes.weight(tail) + 1 if tail else 0
        if head + found[at][1] > sizes.most:
            head, tail = 0, ""
        room, begin = sizes.most - head - found[at][1], at
        at += 1
        while at < len(found) and 1 + found[at][1] <= room:
            room -= 1 + found[at][1]
            at += 1
        content = " ".join(([tail] if tail else []) + [p for p, _ in found[begin:at]]).strip(_TRIM)
        yield start, content
        tail = content[-carried:] if carried else ""
        start += len(content) - len(tail)


def overlap_chunks(text: str, sizes: Sizes) -> Iterator[tuple[int, str]]:
    """(start, content) of chunks of up to a number of characters, filled with paragraphs.

    Chunks are slices of one string, which only grows: each reaches back into the one before by the overlap. A
    paragraph that fits the chunk is written behind a blank line; else the chunk ends, the paragraph is written without
    one, and ends a chunk wherever one is full.
    """
    size, overlap, written, slices, begin, end = sizes.max_size, sizes.overlap, [], [], 0, 0
    for paragraph in filter(None, PARAGRAPHS.split(text)):
        gap = "\n\n" if end > begin else ""
        fits = end - begin + len(gap) + len(paragraph) <= size
        if not fits and end > begin:
            slices.append((begin, end))
            begin = max(begin, end - overlap)
        written += [gap, paragraph] if fits else [paragraph]
        end += sum(map(len, written[-1 - fits :]))
        for full in range(begin + size, end, size - overlap):
            slices.append((begin, full))
            begin = full - overlap
    if end > begin:
        slices.append((begin, end))
    whole = "".join(written)
    return ((a, whole[a:b].strip(_TRIM)) for a, b in slices)


def _walked(df: DataFrame, doc: str, source: Column, walk: Callable[[str], Iterator[tuple[int, str]]]) -> DataFrame:
    """doc, chunk_order, last, start_offset and content of each document's walk."""
    rows = df.select(F.col(doc), source.alias("_t")).where("length(_t) > 0")
    kind = rows.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                at, order, last, out = [], [], [], []
                for row, t in enumerate(part.column(1).to_pylist()):
                    own = list(walk(t))
                    at += [row] * len(own)
                    order += range(len(own))
                    last += [n == len(own) - 1 for n in range(len(own))]
                    out += own
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(order, pa.int32()), pa.array(last, pa.bool_()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string())],
                    names=[doc, "chunk_order", "last", "start_offset", "content"],
                )

    return rows.mapInArrow(run, f"{doc} {kind}, chunk_order int, last boolean, start_offset int, content string")


def recursive(df: DataFrame, doc: str = "doc_id", text: str = "text", sizes: Sizes = Sizes(), links: bool = True) -> DataFrame:
    """Chunks by paragraphs, lines, sentences, words, else windows; offsets are positions in the chunks' own text."""
    cut = _walked(df, doc, tx.chunk_source(F.col(text)), lambda t: recursive_chunks(t, sizes)).withColumn("end_offset", F.col("start_offset") + F.length("content"))
    return with_ids(cut, doc, "recursive") if links else cut.drop("last")


def overlapping(df: DataFrame, doc: str = "doc_id", text: str = "text", sizes: Sizes = Sizes(500, 50), links: bool = True) -> DataFrame:
    """Chunks filled paragraph by paragraph; ids are deterministic."""
    collapsed = tx.trimmed(F.regexp_replace(tx.unix_lines(F.coalesce(F.col(text), F.lit(""))), r"\n{3,}", "\n\n"))
    cut = _walked(df, doc, collapsed, lambda t: overlap_chunks(t, sizes)).drop("start_offset")
    return with_ids(cut, doc, "overlap") if links else cut.drop("last")


STANDALONE = ("TABLE", "IMAGE", "IMAGE_CAPTION", "OCR_TEXT")
HEADINGS = ("TITLE", "HEADING")


def sections(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds ``section_no``, ``section`` (its heading path) and ``section_start`` to blocks in ``block_order``.

    A heading begins a section. One that another heading follows at once is dropped; a last one without blocks
    stays as a section of its own.
    """
    w = Window.partitionBy(doc).orderBy("block_order")
    head = F.col("block_type").isin(*HEADINGS)
    numbered = blocks.withColumn("section_no", F.sum(head.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ws = Window.partitionBy(doc, "section_no")
    path = F.coalesce(F.nullif(tx.trimmed(F.col("heading_path")), F.lit("")), F.col("text"))
    last_no = F.max("section_no").over(Window.partitionBy(doc))
    return (
        numbered.withColumns({"_filled": F.max((~head).cast("int")).over(ws), "_last": last_no, "section": F.coalesce(F.max(F.when(head, path)).over(ws), F.lit("")), "section_start": F.min("block_order").over(ws)})
        .where((F.col("_filled") == 1) | (F.col("section_no") == F.col("_last")))
        .drop("_filled", "_last")
    )


def structured(blocks: DataFrame, doc: str = "doc_id", sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of typed blocks (doc, block_order, block_id, block_type, text, heading_path, source_ref, confidence).

    Blocks of a section are packed up to the largest size; tables, images and recognised text stand alone; headings
    are in the parent's content only. Overlap repeats whole last blocks. Packing folds a section's block sizes into
    chunk numbers, so only sizes pass through the fold; contents are aggregated from the blocks.
    """
    cut = sections(blocks, doc)
    body = cut.where(~F.col("block_type").isin(*HEADINGS)).withColumn("_size", tx.size_in(F.coalesce(F.col("text"), F.lit("")), sizes.unit))
    alone = F.col("block_type").isin(*STANDALONE)
    one = F.struct("block_order", F.col("_size").alias("size"), alone.alias("alone"))
    listed = body.groupBy(doc, "section_no", "section", "section_start").agg(F.array_sort(F.collect_list(one)).alias("b"))
    gap = 1 if sizes.unit == "token" else 2

    def tail(b: Column, first: Column, last: Column) -> Column:
        """The first of the last blocks whose sizes together stay within the overlap, ``last`` + 1 for none."""
        if not sizes.overlap:
            return last + 1

        def back(state: Column, i: Column) -> Column:
            total = state["sum"] + F.element_at(b, i)["size"]
            fits = state["on"] & (total <= sizes.overlap) & ~F.element_at(b, i)["alone"]
            return F.struct(F.when(fits, i).otherwise(state["at"]).alias("at"), F.when(fits, total).otherwise(state["sum"]).alias("sum"), fits.alias("on"))

        start = F.struct((last + 1).alias("at"), F.lit(0).alias("sum"), F.lit(True).alias("on"))
        return F.aggregate(F.reverse(F.sequence(first, last)), start, back, lambda s: s["at"])

    def total(b: Column, first: Column, last: Column) -> Column:
        """Size of the joined content of blocks first to last."""
        sizes_ = F.transform(F.when(first > last, F.array().cast("array<int>")).otherwise(F.sequence(first, last)), lambda i: F.element_at(b, i)["size"])
        return F.aggregate(sizes_, F.lit(0), lambda a, x: F.when(x == 0, a).when(a == 0, x).otherwise(a + gap + x))

    span = "array<struct<first:int,last:int>>"

    def pack(state: Column, i: Column) -> Column:
        b, first, held, done = F.col("b"), state["first"], state["held"], state["done"]
        block = F.element_at(b, i)
        last = i - 1
        emit = F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))
        own = F.array(F.struct(i.cast("int").alias("first"), i.cast("int").alias("last")))
        grown = F.when(held > 0, held + gap).otherwise(F.lit(0)) + block["size"]
        full = (first <= last) & (grown > sizes.max_size)
        begin = F.when(full, tail(b, first, last)).otherwise(first)
        size = F.when(full, total(b, begin, i)).otherwise(F.when(block["size"] == 0, held).otherwise(grown))
        return F.when(block["alone"], F.struct((i + 1).cast("int").alias("first"), F.lit(0).alias("held"), F.concat(done, F.when(first <= last, emit).otherwise(F.array().cast(span)), own).cast(span).alias("done"))).otherwise(
            F.struct(begin.cast("int").alias("first"), size.cast("int").alias("held"), F.when(full, F.concat(done, emit)).otherwise(done).cast(span).alias("done"))
        )

    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("held"), F.array().cast(span).alias("done"))
    n = F.size("b")
    packed = F.aggregate(
        F.sequence(F.lit(1), n), start, pack,
        lambda s: F.when(s["first"] <= F.size("b"), F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), F.size("b").alias("last"))))).otherwise(s["done"]),
    )
    chunks = listed.select(doc, "section_no", "section", "section_start", "b", F.posexplode(packed).alias("_c", "_s"))
    chunks = chunks.select(doc, "section_no", "section", "section_start", "_c", F.explode(F.transform(F.slice("b", F.col("_s.first"), F.col("_s.last") - F.col("_s.first") + 1), lambda x: x["block_order"])).alias("block_order"))
    filled = F.when(tx.trimmed(F.col("text")) != "", F.col("text"))
    detail = body.select(doc, "block_order", "block_id", "block_type", filled.alias("text"), "source_ref", "confidence")
    key = [doc, "section_no", "_c"]
    made = chunks.join(detail, [doc, "block_order"]).groupBy(*key).agg(
        F.first("section").alias("section"),
        F.first("section_start").alias("section_start"),
        F.array_sort(F.collect_list(F.struct("block_order", "text", "block_id", "source_ref", "block_type"))).alias("_b"),
        F.avg("confidence").alias("confidence"),
    )
    parents = cut.groupBy(doc, "section_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", filled.alias("text")))), lambda x: x["text"]), "\n\n").alias("parent_content"))
    kind = F.when(F.size("_b") > 1, "child").otherwise(
        F.when(F.col("_b")[0]["block_type"] == "TABLE", "table").when(F.col("_b")[0]["block_type"] == "OCR_TEXT", "ocr")
        .when(F.col("_b")[0]["block_type"].isin("IMAGE", "IMAGE_CAPTION"), "image-caption").when(F.col("_b")[0]["block_type"] == "PAGE", "slide").otherwise("child")
    )
    order = F.row_number().over(Window.partitionBy(doc).orderBy("section_no", "_c")) - 1
    rows = made.join(parents, [doc, "section_no"]).withColumns(
        {
            "chunk_order": order.cast("int"),
            "content": F.array_join(F.transform("_b", lambda x: x["text"]), "\n\n"),
            "block_ids": _distinct("block_id"),
            "source_refs": _distinct("source_ref"),
            "chunk_type": kind,
            "parent_chunk_id": tx.chunk_id(F.col(doc).cast("string"), F.col("section_start"), "-parent-"),
        }
    )
    w = Window.partitionBy(doc).orderBy("chunk_order")
    same = lambda f, c: F.when(f("parent_chunk_id").over(w) == F.col("parent_chunk_id"), f(c).over(w))
    named = rows.withColumn("chunk_id", tx.chunk_id(F.col(doc).cast("string"), F.col("chunk_order")))
    return named.withColumns({"prev_chunk_id": same(F.lag, "chunk_id"), "next_chunk_id": same(F.lead, "chunk_id"), "char_count": F.length("content"), "token_count": tx.token_estimate(F.col("content")), "content_hash": tx.content_hash(F.col("content"))}).drop("_b", "_c", "section_no", "section_start")


def _distinct(field: str) -> Column:
    """A field's distinct non-blank values in block order."""
    return F.array_distinct(F.filter(F.transform("_b", lambda x: tx.trimmed(x[field])), lambda v: v.isNotNull() & (v != "")))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"fixed-size": fixed, "recursive": recursive, "overlap": overlapping}


def chunk(df: DataFrame, strategy: str = "recursive", **options) -> DataFrame:
    """Chunks by a registered strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return STRATEGIES[strategy](df, **options)
