"""Text of paged documents: repeated boundary lines, broken lines, tables set in columns, recognised words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx


def without_boundaries(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page, text -> the pages without lines that repeat at page boundaries.

    A page's first and last lines count, each once; a line that occurs there in at least half of a document's pages,
    and twice at least, goes from every place of every page. One-page documents keep theirs.
    """
    lines = pages.select(doc, "page", F.posexplode(F.split(tx.unix_lines(F.col("text")), "\n")).alias("at", "line")).withColumn("plain", tx.squeezed(F.col("line")))
    filled = lines.where("plain <> ''")
    ends = filled.groupBy(doc, "page").agg(F.min_by("plain", "at").alias("first"), F.max_by("plain", "at").alias("last"))
    total = pages.groupBy(doc).agg(F.countDistinct("page").alias("pages"))
    often = ends.select(doc, F.explode(F.array("first", "last")).alias("plain")).groupBy(doc, "plain").agg(F.count("*").alias("n")).join(total, doc)
    often = often.where((F.col("pages") > 1) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.5)))).select(doc, "plain")
    kept = lines.join(often, [doc, "plain"], "left_anti").groupBy(doc, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select(doc, "page").join(kept, [doc, "page"], "left").withColumn("text", tx.trimmed(F.coalesce("text", F.lit(""))))


def mended(c: Column) -> Column:
    """The text with its lines joined again where it has eight lines or more and a third of them (35 %) hold three
    characters or fewer: no space before closing marks or after opening ones."""
    lines = F.filter(F.transform(F.split(c, "\n"), tx.trimmed), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 3))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), r" ([.,;:!?%)\]}])", "$1"), r"([(\[{]) ", "$1")
    return F.when((F.size(lines) >= 8) & (short >= 0.35 * F.size(lines)), joined).otherwise(c)


def paragraphs(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page, paragraph number and text, parted by blank lines."""
    cut = pages.select(doc, "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("paragraph", "text"))
    return cut.withColumn("text", tx.trimmed(F.col("text"))).where("text <> ''")


def _column_runs(pages: DataFrame, doc: str) -> DataFrame:
    """Lines in a row that have two parts or more, parted by two spaces or more, by run: doc, page, run, at, parts, n."""
    lines = pages.select(doc, "page", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    parts = lines.withColumn("parts", F.filter(F.split(tx.trimmed(F.col("line")), r" {2,}"), lambda x: x != "")).withColumn("n", F.size("parts"))
    w = Window.partitionBy(doc, "page").orderBy("at")
    # what is no part of a run ends the one before
    return parts.withColumn("run", F.sum((F.col("n") < 2).cast("int")).over(w)).where("n >= 2")


def column_tables(pages: DataFrame, doc: str = "doc_id", separator: bool = False) -> DataFrame:
    """Tables that spaces set: two or more lines in a row with two parts or more, parted by two spaces or more, all with
    the same number. doc, page, first line, number of rows and columns, markdown, with a line of dashes behind the first
    row if ``separator`` is set. Lines of unequal numbers are no table (``column_table_warnings``)."""
    row = F.concat(F.lit("| "), F.array_join("parts", " | "), F.lit(" |"))
    made = _column_runs(pages, doc).groupBy(doc, "page", "run").agg(
        F.min("at").alias("first_line"), F.count("*").cast("int").alias("rows"), F.min("n").alias("_least"), F.max("n").alias("columns"), F.transform(F.array_sort(F.collect_list(F.struct("at", row.alias("r")))), lambda x: x["r"]).alias("_r")
    )
    dashes = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("columns")), " | "), F.lit(" |"))
    listed = F.concat(F.slice("_r", 1, 1), F.array(dashes), F.slice("_r", 2, F.size("_r"))) if separator else F.col("_r")
    return made.where("rows >= 2 and _least = columns").withColumn("markdown", F.array_join(listed, "\n")).drop("run", "_least", "_r")


def column_table_warnings(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines in a row that look like a table but differ in their number of parts: doc, page, first line, code, message."""
    made = _column_runs(pages, doc).groupBy(doc, "page", "run").agg(F.min("at").alias("first_line"), F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"))
    said = made.where("rows >= 2 and least < most").withColumns({"code": F.lit("TABLE_RECONSTRUCTION_PARTIAL"), "message": F.lit("rows of unequal numbers of columns")})
    return said.select(doc, "page", "first_line", "code", "message")


def dealt(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows dealt to all tasks by document, a document's rows one after another."""
    return rows.repartition(F.col(doc)).sortWithinPartitions(doc)


#: What is known of a word, besides its document.
WORD = ("text", "confidence", "x", "y", "width", "height")


def word_lines(words: DataFrame, doc: str = "doc_id", order: str | None = None) -> DataFrame:
    """Recognised words (doc, text, confidence, x, y, width, height) to lines: text, mean and least confidence.

    Words are taken by ``order``, or from top to bottom, those without a box last. A word belongs to the FIRST line so far
    whose box it overlaps, by half the smaller height (in whole units) and by more than nothing; if there is none it
    begins a line. A word without a box belongs to the latest line. Inside a line words go from left to right. A
    confidence below 0 is none, one above 1 a percentage.

    Words are moved once, to their document; where a page's words are at hand as arrays, ``page_lines`` moves none.
    """
    known = F.collect_list(F.struct(*[F.col(c) for c in WORD], *([F.col(order).alias("rank")] if order else [])))
    listed = words.where("trim(text) <> ''").groupBy(doc).agg(known.alias("w")).select(doc, *[F.col(f"w.{c}").alias(c) for c in WORD], *([F.col("w.rank").alias("rank")] if order else []))
    return page_lines(listed, doc, "rank" if order else None)


def dealt(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows dealt to all tasks by document, a document's rows one after another."""
    return rows.repartition(F.col(doc)).sortWithinPartitions(doc)


def page_lines(pages: DataFrame, doc: str = "doc_id", order: str | None = None) -> DataFrame:
    """The lines of ``word_lines`` from pages whose words are arrays of one length (text, confidence, x, y, width, height, and
    ``order``). Several rows of one document must stand together, as ``dealt`` leaves them; nothing is moved here.

    The fold is by whole documents inside Arrow tasks, some 65536 words at once, and in it all lines of like size together.
    """
    kinds = {"text": "array<string>", "confidence": "array<double>"}
    given = pages.select(F.col(doc).alias("doc"), *[F.col(c).cast(kinds.get(c, "array<int>")).alias(c) for c in WORD], *([F.col(order).alias("rank")] if order else []))
    schema = T.StructType([pages.select(doc).schema[0], *T._parse_datatype_string("line int, text string, confidence double, least_confidence double, top int").fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ends in whole_runs(words_of(batches)):
            yield from lines_of_words(part, ends, schema.fieldNames()).to_batches(10000)

    return given.mapInArrow(fold, schema)


def words_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The words of pages, a row each, without blank ones: doc, rank (top to bottom unless it is given), and what is known."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            lists = dict(zip(part.schema.names, part.columns, strict=True))
            sizes = np.asarray(lists["text"].value_lengths().fill_null(0))
            made = {"doc": lists["doc"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))}
            made |= {c: lists[c].flatten() for c in lists if c != "doc"}
            if "rank" not in made:
                made["rank"] = pc.or_(made["y"].is_null(), made["height"].is_null()).cast(pa.int64())
            sure = made["confidence"]
            sure = pc.if_else(pc.greater(sure, 1), pc.divide(sure, 100.0), sure)
            made["confidence"] = pc.if_else(pc.less(sure, 0), pa.scalar(None, pa.float64()), sure)
            said = pc.fill_null(pc.not_equal(pc.ascii_trim(made["text"], " "), ""), False)
            words = pa.RecordBatch.from_pydict(made)
            yield words if pc.all(said).as_py() is not False else words.filter(said)


def whole_runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of ``least`` rows or so that end where a run of equal values in the first column does, with the runs' ends."""
    held, rows, wanted = [], 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= wanted:
            table, ends = _runs(held)
            if len(ends) > 1:
                cut = int(ends[-2])
                yield table.slice(0, cut), ends[:-1]
                table = table.slice(cut)
            held, rows = table.to_batches(), len(table)
            wanted = max(least, 2 * rows)  # so that a long run is not put together for each batch of it
    if rows:
        yield _runs(held)


def _runs(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    return table, np.asarray(pc.run_end_encode(table.column(0).combine_chunks(), run_end_type=pa.int64()).run_ends)


def lines_of_words(words: pa.Table, ends: np.ndarray, names: list[str]) -> pa.Table:
    """The lines of whole documents, whose words end at ``ends``."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    if not _in_order(words, owner):
        keyed = words.append_column("owner", pa.array(owner))
        by = ("owner", "rank", "y", "x", "width", "height", "text", "confidence")
        words = words.take(pc.sort_indices(keyed, [(c, "ascending") for c in by], null_placement="at_start")).combine_chunks()
    field = {c: words.column(c).combine_chunks() for c in words.column_names}
    whole = lambda c: np.asarray(field[c].fill_null(0), np.int64)
    placed = np.asarray(field["y"].is_valid())
    top, bottom = whole("y"), whole("y") + whole("height")
    line, number = lines_of(owner, top, bottom, placed & np.asarray(field["height"].is_valid()))
    order = np.argsort(line * (1 << 33) + whole("x"), kind="stable")  # words at one place stay in their order
    line = line[order]
    begins = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
    of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(line)]))
    texts = pc.ascii_trim(field["text"].take(pa.array(order)), "".join(map(chr, range(33))))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[begins, len(line)].astype(np.int32)), texts), " ")
    known = np.asarray(field["confidence"].is_valid())[order]
    sure = np.asarray(field["confidence"].fill_null(0))[order]
    n = np.bincount(of[known], minlength=len(begins))
    mean = np.bincount(of[known], sure[known], len(begins)) / np.maximum(n, 1)
    least = np.fmin.reduceat(np.where(known, sure, np.nan), begins)
    none = np.iinfo(np.int32).max
    upper = np.minimum.reduceat(np.where(placed, top, none)[order], begins)
    some = np.bincount(of[placed[order]], minlength=len(begins)) > 0
    columns = [field["doc"].take(pa.array(order[begins])), pa.array(number[order[begins]].astype(np.int32)), joined, pa.array(mean, mask=n == 0), pa.array(least, mask=n == 0), pa.array(upper.astype(np.int32), mask=~some)]
    return pa.Table.from_arrays(columns, names=names)


def _in_order(words: pa.Table, owner: np.ndarray) -> bool:
    """Whether words stand in the order that they are taken in, and none at the place of another."""
    if not pa.types.is_integer(words.schema.field("rank").type) or words.column("rank").null_count:
        return False
    tie = owner[1:] == owner[:-1]
    for c in ("rank", "y", "x", "width", "height"):
        value = words.column(c).combine_chunks()
        v = np.asarray(value if c == "rank" else value.cast(pa.int64()).fill_null(-(1 << 40)), np.int64)
        if (tie & (v[1:] < v[:-1])).any():
            return False
        tie &= v[1:] == v[:-1]
    return not tie.any()


#: Beyond all tops and bottoms, which are sums of two int.
FAR = 1 << 34


def lines_of(owner: np.ndarray, top: np.ndarray, bottom: np.ndarray, boxed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word's line among all lines and in its document, by the rule of ``word_lines``. ``owner``: the
    words' documents, in order.

    Words whose boxes overlap, with each other or by way of others, are a band, and a line lies in one band. So bands are
    folded beside each other: the first word of each, then the second of each, and so on.
    """
    n = len(top)
    maker = np.arange(n)  # the word that began a word's line
    word = np.flatnonzero(boxed)
    by_top = word[np.argsort(owner[word] * FAR + top[word], kind="stable")]
    reach = np.maximum.accumulate(bottom[by_top] + owner[by_top] * FAR)
    apart = np.r_[True, (top[by_top] + owner[by_top] * FAR)[1:] >= reach[:-1]][: len(by_top)]
    band = np.empty(n, np.int64)
    band[by_top] = np.cumsum(apart) - 1
    word = word[np.argsort(band[word], kind="stable")]  # by band, and as they are taken
    size = np.bincount(band[word]) if len(word) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    most = 2
    while len(size) and most < 2 * size.max():  # bands of like size together; one of one word is its own line
        some = np.flatnonzero((size > most // 2) & (size <= most))
        some = some[np.argsort(-size[some], kind="stable")]
        _fold_bands(word, first[some], size[some], top, bottom, maker)
        most *= 2
    begins = np.r_[True, owner[1:] != owner[:-1]][:n]
    new = np.where(boxed, maker == np.arange(n), begins)  # without a line so far, a word without a box begins one
    latest = np.cumsum(new) - 1
    line = np.where(boxed, latest[maker], latest)
    return line, line - np.repeat(latest[begins], np.diff(np.r_[np.flatnonzero(begins), n]))


def _fold_bands(word: np.ndarray, first: np.ndarray, size: np.ndarray, top: np.ndarray, bottom: np.ndarray, maker: np.ndarray) -> None:
    """Sets ``maker`` of the words of bands, the largest first; a band's words are ``size`` from ``first`` on of ``word``."""
    if not len(size):
        return
    upper = np.full((len(size), int(size[0])), FAR)  # of a line that is not begun: overlaps nothing
    lower, began, n = -upper, np.zeros_like(upper), np.zeros(len(size), np.int64)
    for t in range(int(size[0])):
        k = int(np.searchsorted(-size, -t))
        w, own = word[first[:k] + t], np.arange(k)
        a, b = top[w], bottom[w]
        lines = int(n[:k].max()) or 1
        up, low = upper[:k, :lines], lower[:k, :lines]
        shared = np.minimum(low, b[:, None]) - np.maximum(up, a[:, None])
        met = (shared > 0) & (shared >= np.minimum(low - up, (b - a)[:, None]) >> 1)
        at = met.argmax(1)
        new = ~met[own, at]
        at[new] = n[:k][new]
        began[own[new], at[new]] = w[new]
        n[:k] += new
        upper[own, at], lower[own, at] = np.minimum(upper[own, at], a), np.maximum(lower[own, at], b)
        maker[w] = began[own, at]


def word_quality(lines: DataFrame, doc: str = "doc_id", low: float = 0.6) -> DataFrame:
    """Each document's least confidence, and whether it warns of a low one."""
    return lines.groupBy(doc).agg(F.min("least_confidence").alias("least_confidence")).withColumn("low_confidence", F.coalesce(F.col("least_confidence") < low, F.lit(False)))


def captions(images: DataFrame, boxes: DataFrame, page: str = "slide") -> DataFrame:
    """Each image's caption: the text of the nearest box whose top is at or below the image's bottom (of several at that
    place the least text). images: page, image_id, bottom; boxes: page, top, text.

    An as-of join: images and boxes of a page are one sorted column, in which each image takes the next box; no pairs are
    made, and a page's boxes are reduced to one a place first.
    """
    tops = boxes.where("top is not null").groupBy(page, "top").agg(F.min("text").alias("text"))
    at = tops.select(page, F.col("top").alias("_at"), F.lit(1).alias("_kind"), F.struct("text").alias("_box"), F.lit(None).cast(images.schema["image_id"].dataType).alias("image_id"))
    asked = images.select(page, F.col("bottom").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("struct<text:string>").alias("_box"), "image_id")
    ahead = Window.partitionBy(page).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    met = at.unionByName(asked).withColumn("_next", F.first("_box", ignorenulls=True).over(ahead)).where("_kind = 0")
    near = met.groupBy(page, "image_id", F.col("_at").alias("bottom")).agg(F.first("_next.text").alias("caption"))
    return images.join(near, [page, "image_id", "bottom"], "left")
