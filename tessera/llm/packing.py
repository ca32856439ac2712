"""Harmonic packing of token sequences.

A piece of length n belongs to the class k = capacity // n: k pieces of at most capacity // k tokens fill a bin of
the class, so a bin is complete by a count alone and workers fill bins without knowing of each other. Documents
may be cut: whole capacities are cut off first; a rest whose class would leave much room is cut at the next lower
reciprocal, capacity // (k + 1), which fills its own class's share exactly. What is left in unfinished bins when a
task ends is placed, longest first, into common bins, so a task leaves about one bin unfilled.

Null texts are empty (they have the end id only); repeated rows and ties are packed once each. An empty table
gives no pieces. The order of rows in a task decides where pieces go; a task that is run again reads the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table, text_slices
from tessera.llm.word_tokens import make_encoder

CAPACITY = 4096
#: A piece may leave this share of its bin's portion unused before it is cut instead.
SLACK = 1 / 64
#: Sequence ids count up within a task; the task's number stands above these bits.
TASK_BITS = 36

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths into which a document of n tokens is cut, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        share = capacity // k
        if share - n <= slack * share or capacity // (k + 1) < 16:
            out.append(n)
            break
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


class Bins:
    """One task's open bins, one for each class."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, first_id, {}

    def add(self, piece: tuple, n: int) -> list[tuple]:
        """Takes a piece; returns those of its bin with their places once the bin is complete."""
        k = self.capacity // n
        held = self.open.setdefault(k, [])
        held.append((piece, n))
        return self._close(self.open.pop(k)) if len(held) == k else []

    def _close(self, held: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for piece, n in held:
            out.append((piece, self.next, at))
            at += n
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        """Places what is in unfinished bins; their number of pieces is bounded by the classes."""
        left = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[1])
        bins: list[tuple[int, list]] = []
        for x in left:
            for i, (used, held) in enumerate(bins):
                if used + x[1] <= self.capacity:
                    held.append(x)
                    bins[i] = (used + x[1], held)
                    break
            else:
                bins.append((x[1], [x]))
        self.open = {}
        return [y for _, held in bins for y in self._close(held)]


def pack(df: DataFrame, tokenizer_path: str, text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """One row per piece: the columns of ``df`` but the text, and where the piece's tokens begin in its document
    (``start``), their number, the ids as little-endian 32-bit integers, the document's number of tokens, and the
    sequence and offset they are placed at.

    No sequence exceeds ``capacity``; offsets are gapless from 0. No shuffle: every task packs what it reads.
    """
    added = T._parse_datatype_string(PIECES)
    keep = [f for f in df.schema.fields if f.name != text_col and f.name not in added.fieldNames()]
    schema = T.StructType(keep + added.fields)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(tokenizer_path, end_id)
        context = TaskContext.get()
        bins = Bins((context.partitionId() if context else 0) << TASK_BITS, capacity)
        kinds = None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            keys = [p[0][0] for p in placed]
            arrays = [pa.array([k[i] for k in keys], kinds[i]) for i in range(len(names))]
            arrays += [pa.array([p[0][1] for p in placed], pa.int64()), pa.array([len(p[0][2]) // 4 for p in placed], pa.int64()), pa.array([p[0][2] for p in placed], pa.binary())]
            arrays += [pa.array([p[0][3] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64()), pa.array([p[2] for p in placed], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

        for batch in batches:
            kinds = kinds or [batch.schema.field(k).type for k in names]
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names]
            for i, j in text_slices(texts):
                flat, lengths = encode(texts[i:j])
                placed, at = [], 0
                for row, n in zip(range(i, j), lengths.tolist(), strict=True):
                    key, start = tuple(c[row] for c in columns), 0
                    raw = flat[at : at + n].astype("<i4").tobytes()
                    for length in cuts(n, capacity, slack):
                        placed += bins.add((key, start, raw[4 * start : 4 * (start + length)], n), length)
                        start += length
                    at += n
                for k in range(0, len(placed), 5000):
                    yield rows(placed[k : k + 5000])
        if last := bins.rest():
            yield rows(last)

    return df.mapInArrow(run, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with a checksum of their ids."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
