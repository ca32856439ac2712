"""What the operators of this subpackage share: table reading, shared folders, batching in tasks."""

from __future__ import annotations

import contextlib
import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where a session in one local process names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"
#: The setting by which Spark removes an execution's shuffle files when it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of text that a task holds in expanded form (word lists, token ids) at a time.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named Parquet table, restricted to ``columns`` so that only they are scanned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session in one
    local process has a default; on a cluster that is an error, as no other folder is known to be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or LOCAL_SHARED).rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would take it to have."""
    files, at = _filesystem(spark, path)
    return files.makeQualified(at).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. The application's folder goes when it ends."""
    own = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    files, at = _filesystem(spark, own)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """What is executed here leaves no shuffle files: its rows are in the shared folder, and nothing reads it again."""
    was = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, was)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder, in folders ``by`` these columns, and reads it back: later steps
    neither recompute it nor depend on an executor's disk, and the shuffle files that it took go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _shuffles_go(spark):
        df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what ``stored`` wrote, once nothing will read it again."""
    files, at = _filesystem(df.sparkSession, df.stored_at)
    files.delete(at, True)


class Scratch:
    """The stored tables of one computation, which go together once its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        return self.own(stored(df, name, *by))

    def own(self, table: DataFrame) -> DataFrame:
        """A stored table that is to go with the others."""
        self.tables.append(table)
        return table

    def discard(self, *tables: DataFrame) -> None:
        """These go now."""
        for t in tables:
            discard(t)
            self.tables = [x for x in self.tables if x is not t]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` stored, and everything else removed."""
        out = stored(df, name)
        self.discard(*self.tables)
        return out


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` as a table in the shared folder, dealt into buckets by ``keys``, one file each: joins on these keys move
    the other side only, however often the table is read. ``forget`` drops the table's entry."""
    spark = df.sparkSession
    path, n = fresh_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{_own_tables(spark)}{name}_{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(at)
    return spark.table(at)


def _own_tables(spark: SparkSession) -> str:
    return "tessera_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower() + "_"


def forget(spark: SparkSession) -> None:
    """Drops what this application has left in the catalog and the shared folder; results that weren't written yet are
    lost. Without it the folder goes when the application ends, and so do entries of a catalog in memory."""
    for t in spark.catalog.listTables():
        if t.name.startswith(_own_tables(spark)):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    files, at = _filesystem(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")
    files.delete(at, True)


def text_slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` characters; a longer text has a range of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]], added: str) -> DataFrame:
    """Adds columns computed from whole texts, null read as empty, inside Arrow tasks.

    ``make()`` builds a task's function once; that gets a list of texts and returns arrays by column name.
    ``added`` is the DDL of the new columns; a column of the same name in ``df`` is replaced.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(added)
    old = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    schema = T.StructType(old + new.fields)
    keep = [f.name for f in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            texts = [t or "" for t in column.to_pylist()]
            for i, j in text_slices(texts):
                got = f(texts[i:j])
                part = batch.slice(i, j - i)
                arrays = [part.column(part.schema.get_field_index(k)) for k in keep] + [got[k] for k in new.fieldNames()]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + new.fieldNames())

    return df.mapInArrow(run, schema)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class WordIds:
    """Id sequences of words, each encoded once for as long as it is remembered.

    ``encode`` turns a list of new words into (flat ids, lengths). At ``limit`` words, or ``most_chars`` characters of
    them, the memory is emptied, so a worker's memory is bounded also where words are as long as texts; results don't
    depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000, most_chars: int = 12_000_000):
        self.encode, self.limit, self.most_chars = encode, limit, most_chars
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        grown = np.empty(max(2 * len(array), used + more), array.dtype)
        grown[:used] = array[:used]
        return grown

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words in order, and each word's number of ids."""
        if len(self.index) > self.limit or self.chars > self.most_chars:
            self._clear()
        codes = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(codes < 0)
        if len(miss):
            missed = [words[i] for i in miss]
            new = list(dict.fromkeys(missed))
            flat, lengths = self.encode(new)
            n = len(self.index)
            self.flat = self._room(self.flat, self.used, len(flat))
            self.starts, self.lengths = self._room(self.starts, n, len(new)), self._room(self.lengths, n, len(new))
            self.flat[self.used : self.used + len(flat)] = flat
            self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[n : n + len(new)] = lengths
            self.used += len(flat)
            self.chars += sum(map(len, new))
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            codes[miss] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(miss))
        lengths = self.lengths[codes]
        return self.flat[expand(self.starts[codes], lengths)], lengths


def sums_by(lengths: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of consecutive groups of ``lengths``; a group may be empty."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - np.asarray(counts, np.int64)]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values and each row's length."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind or pa.int32()))
