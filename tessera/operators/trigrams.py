"""Contains-search by an index of three-character grams.

The index has, for each gram and slice of rows, which rows of the slice have a lower-case text that holds it, as bytes;
one row a slice says which rows these are. The texts themselves stand in blocks. A pattern's literal runs of three
characters and more give grams that a matching text must hold; rows that hold all of them are candidates, and only the
blocks that hold candidates are read, to try the pattern. ``%`` and ``_`` keep their meaning, so results are those of
trying every text; a pattern without a run of three characters tries every text.

Null texts match nothing. Repeated rows are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import fresh_folder, written

#: Characters of a gram, and blocks that texts are kept in.
GRAM, BLOCKS = 3, 64
#: Rows of a slice, as many as a byte numbers, and characters of its texts unless it is one text.
SLICE, SLICE_CHARS = 128, 1 << 20
#: What stands for a gram in the row that lists a slice's rows.
LIST = -1


@dataclass(frozen=True)
class Index:
    grams: DataFrame  # gram (see codes), slice, held: numbers in the slice, rows: row numbers of the slice, where gram is LIST
    texts: DataFrame  # the table's columns, _row, _text (lower-case), _block
    blocks: int


def codes(text: str) -> np.ndarray:
    """The distinct grams of a text as numbers, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    parts = [np.unique(p[:-2] << 42 | p[1:-1] << 21 | p[2:]) for p in (c[i : i + SLICE_CHARS + GRAM - 1] for i in range(0, max(1, len(c) - GRAM + 1), SLICE_CHARS)) if len(p) >= GRAM]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.int64), *parts]))


def build(docs: DataFrame, text: str = "text", blocks: int = BLOCKS) -> Index:
    """The index of a table, written to the shared folder: its rows in blocks, and the rows of each gram, in order of
    grams. A slice's distinct grams are found where it is, and what is moved is one row for each, a byte for each of its rows."""
    spark, path = docs.sparkSession, fresh_folder(docs.sparkSession, "texts")
    own = docs.withColumns({"_row": F.monotonically_increasing_id(), "_text": F.lower(text)})
    own = own.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    own.write.partitionBy("_block").parquet(path)
    texts = spark.read.schema(T.StructType([*(f for f in own.schema.fields if f.name != "_block"), own.schema["_block"]])).parquet(path)

    def postings(rows: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        gram = np.concatenate(held)
        at = np.repeat(np.arange(len(held), dtype=np.int8), [len(h) for h in held])
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
        n = len(new)
        starts = np.r_[new, len(gram)].astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[gram[new], LIST]), pa.array(np.full(n + 1, rows[0])),
            pa.ListArray.from_arrays(pa.array(np.r_[starts, len(gram)].astype(np.int32)), pa.array(at)),
            pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(n + 1), len(rows)].astype(np.int32)), pa.array(rows, pa.int64())),
        ], names=["gram", "slice", "held", "rows"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, chars = [], [], 0
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if rows and (len(rows) == SLICE or chars + len(t) > SLICE_CHARS):
                    yield postings(rows, held)
                    rows, held, chars = [], [], 0
                rows.append(row)
                held.append(codes(t))
                chars += len(t)
        if rows:
            yield postings(rows, held)

    parts = texts.where("_text is not null").select("_row", "_text").mapInArrow(found, "gram long, slice long, held array<byte>, rows array<long>")
    # a frequent gram has one row a slice, so none of the index grows with the table; rows that list slices are spread by slice
    grams = written(parts.repartition("gram", F.when(F.col("gram") == LIST, F.col("slice"))).sortWithinPartitions("gram", "slice"), "grams")
    return Index(grams, texts, blocks)


def grams_of(pattern: str) -> list[str]:
    """The grams that a text must hold to match the lower-cased pattern, as far as they don't depend on wildcards."""
    runs = re.split(r"[%_]", re.sub(r"\\(.)", lambda m: m[1] if m[1] not in "%_" else "%", pattern.lower()))
    return sorted({r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})


def candidates(index: Index, pattern: str) -> DataFrame | None:
    """Numbers of the rows that hold all grams of the pattern; none if it has no gram."""
    grams = grams_of(pattern)
    if not grams:
        return None
    held = index.grams.where(F.col("gram").isin([int(codes(g)[0]) for g in grams])).select("slice", F.explode("held").alias("at"))
    all_ = held.groupBy("slice", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return all_.join(index.grams.where(F.col("gram") == LIST).select("slice", "rows"), "slice").select(F.get("rows", F.col("at").cast("int")).alias("_row"))


def matching(text: Column, pattern: str) -> Column:
    """If the text is like the pattern. What stands between two ``%`` is sought from left to right and kept where it is found
    first, which any match can be moved to; ``LIKE`` tries all places of each with all of the others."""
    parts, at = [[]], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            if at == len(pattern) or pattern[at] not in "%_\\":
                raise ValueError(f"a pattern's escape must stand before one of % _ \\: {pattern!r}")
            c = "\\" + pattern[at]
        elif c == "_":
            c = "."
        elif not c.isalnum() and c.isascii() and c != "%":
            c = "\\" + c
        if c == "%":
            parts.append([])
        else:
            parts[-1].append(c)
        at += 1
    first, *others = map("".join, parts)
    if not others:
        return text.rlike(rf"(?s)\A{first}\z")
    return text.rlike(rf"(?s)\A{first}" + "".join(f"(?>.*?{p})" for p in others[:-1] if p) + (rf".*{others[-1]}\z" if others[-1] else ""))


def like(index: Index, pattern: str) -> DataFrame:
    """The table's rows whose text is like the pattern, in any case."""
    names = [c for c in index.texts.columns if c not in ("_row", "_text", "_block")]
    rows, may = index.texts, candidates(index, pattern)
    if may is not None:
        may = written(may, "candidates")
        some = [r.b for r in may.select(F.pmod(F.xxhash64("_row"), F.lit(index.blocks)).cast("int").alias("b")).distinct().collect()]  # one row a block
        rows = rows.where(F.col("_block").isin(some)).join(may, "_row", "left_semi")
    return rows.where(matching(F.col("_text"), pattern.lower())).select(*names)


def contains(index: Index, keyword: str) -> DataFrame:
    """The table's rows whose text contains the keyword, in any case; its ``%`` and ``_`` are wildcards."""
    return like(index, f"%{keyword}%")
