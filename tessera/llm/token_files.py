"""Token ids in Parquet files that allow selective reads.

Each row is one document: its key, the number of tokens before it in its file, its number of tokens and the ids as
a list column. Ids are dictionary-encoded (a vocabulary fits a dictionary page), the ascending numbers are
delta-encoded, row groups and pages have a set size, and Spark's writer adds column and offset indexes, so a reader
that filters by key touches only some pages, and one that wants lengths only never reads ids.

Rows are in ascending key order over all files (nulls first, rows of equal keys side by side, in any order). Null
texts are empty: they have the end id only. An empty table gives files without rows. Columns beside key and text
are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_path, list_array, table, text_slices
from tessera.llm.word_tokens import make_encoder

LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#part": "true",
    "parquet.enable.dictionary#key": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text_col: str = "text", end_id: int | None = 1, layout: dict | None = None) -> None:
    """Encodes every whole text and writes the files to ``path``, ascending by ``key``.

    Only the raw rows are moved, by ranges of the key; a task encodes and writes its range as it streams by. Null keys
    come first; rows of one key follow each other by text, so every run writes the same.
    """
    schema = T._parse_datatype_string("key long, part int, start_in_part long, n_tokens long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, part = make_encoder(tokenizer_path, end_id), 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in text_slices(texts):
                flat, n = encode(texts[i:j])
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(starts), pa.array(n), list_array(flat, n)], names=schema.fieldNames()
                )

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    rows.mapInArrow(run, schema).write.options(**(layout or LAYOUT)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such files with ``start``, the number of tokens of all documents before a row's.

    Each file's total comes from its number columns alone; there is one small row per file.
    """
    rows = spark.read.schema("key long, part int, start_in_part long, n_tokens long, ids array<int>").parquet(path)
    totals = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    before, base = 0, []
    for part, total in sorted(map(tuple, totals.collect())):  # one row per written file
        base.append((part, before))
        before += total
    offsets = spark.createDataFrame(base, "part int, base long")
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base", "part", "start_in_part")


def with_ids_crc32(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Replaces a list of ids by ``ids_crc32``, the checksum of its little-endian 32-bit integers."""
    import zlib

    keep = [f for f in df.schema.fields if f.name != ids_col]
    schema = T.StructType([*keep, T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_pylist()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in keep] + [pa.array(crc, pa.int64())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to files and returns what the files hold, as a start, a number and a checksum."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_ids_crc32(read_tokens(spark, path)).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
