"""Chunk stores as rewrites of tables, and their atomic replacement on disk.

Each operation is a function from the stored table and the change to the new table; ``TableStore`` writes a version
into a folder of its own and then creates a pointer file, so readers see the old or the new version, never both, and of
two writers that began from one version the second fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as vx

KEY = ("object_type", "object_id", "chunk_index")


def one_each(df: DataFrame, key: Sequence[str], order: Column | None, last: bool) -> DataFrame:
    """The last (or first) row of each key by ``order``, the order of writing. Without one, and among rows that tie, it is
    the one whose columns, as JSON, are the largest (or smallest), so the choice doesn't change from run to run. Rows
    are reduced before they are moved."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(F.lit(0) if order is None else order, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), rank)
    return df.groupBy(*key).agg(pick.alias("_row")).select(*key, "_row.*").select(*df.columns)


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str] = KEY, order: Column | None = None) -> DataFrame:
    """Rows of the change, of each key the last by ``order``, and stored rows whose key it doesn't have."""
    change = one_each(new, key, order, True).select(*stored.columns)
    return stored.join(change.select(*key), list(key), "left_anti").select(*stored.columns).unionByName(change)


def insert_missing(stored: DataFrame, new: DataFrame, key: Sequence[str] = KEY, order: Column | None = None) -> DataFrame:
    """The rows of the change whose key isn't stored, of each key the first by ``order``: what an insert that ignores
    conflicts appends. Their number is the count of rows affected."""
    return one_each(new, key, order, False).join(stored.select(*key), list(key), "left_anti").select(*stored.columns)


def replace_scope(stored: DataFrame, new: DataFrame, scope: Sequence[str] = KEY[:2]) -> DataFrame:
    """Stored rows outside the change's scopes, and the change."""
    return stored.join(new.select(*scope).distinct(), list(scope), "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def delete(stored: DataFrame, condition: Column) -> DataFrame:
    """Without the rows that meet the condition; rows for which it is null stay."""
    return stored.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows whose key is listed; the key is what the list's columns are."""
    return stored.join(keys.distinct(), keys.columns, "left_anti").select(*stored.columns)


def update(stored: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns of the rows that meet the condition."""
    met = F.coalesce(condition, F.lit(False))
    return stored.withColumns({k: F.when(met, v).otherwise(F.col(k)) for k, v in values.items()})


def record(chunks: DataFrame, model: str = "stub", dimension: int | None = None) -> DataFrame:
    """Store rows of chunks (document_id, metadata map of strings, embedding, others): scope and index from the metadata
    or their defaults, the document's id in the metadata unless it has one, vectors narrowed."""
    said = lambda name: F.element_at("metadata", F.lit(name))
    index = F.coalesce(said("chunkOrder"), said("chunkIndex"))
    own = F.create_map(F.lit("documentId"), F.col("document_id"))
    return chunks.withColumns({
        "object_type": F.coalesce(said("objectType"), F.lit("DEFAULT")),
        "object_id": F.coalesce(F.when(F.trim(said("objectId")) != "", said("objectId")), F.col("document_id")),
        "chunk_index": F.coalesce(F.when(index.rlike(r"^[+-]?[0-9]+$"), index.try_cast("int")), F.lit(0)),
        "metadata": F.when(said("documentId").isNull(), F.map_concat(F.map_filter("metadata", lambda k, _: k != "documentId"), own)).otherwise(F.col("metadata")),
        "embedding": vx.as_stored(F.col("embedding")),
        "embedding_model": F.lit(model),
        "embedding_dimension": F.size("embedding") if dimension is None else F.lit(dimension),
    })


class TableStore:
    """A table in versions under a folder; the pointer names the current one."""

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ("object_type",)):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)
        jvm = spark._jvm
        self.folder = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The current version, -1 for none."""
        return max(self._pointers(), default=-1)

    def _pointers(self) -> dict[int, str]:
        """The folder that the pointer of each version names."""
        if not self.fs.exists(self.folder):
            return {}
        names = [s.getPath().getName().split("-") for s in self.fs.listStatus(self.folder)]
        return {int(n[1]): n[2] for n in names if n[0] == "current"}

    def read(self) -> DataFrame:
        """The current version."""
        folders = self._pointers()
        if not folders:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return self.spark.read.parquet(f"{self.path}/{folders[max(folders)]}")

    def commit(self, df: DataFrame, of: int | None = None) -> int:
        """Writes a new version and makes it current. ``of`` is the version that ``df`` was made from, the current one
        unless given; if another writer has replaced that, nothing changes and this fails. The version before stays for
        readers that have begun."""
        before = self.version() if of is None else of
        folder = f"v{before + 1}x{uuid.uuid4().hex}"
        df.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{folder}")
        claim = self._path(f"{self.path}/claim-{before + 1}")
        if self.version() != before or not self.fs.createNewFile(claim):
            self.fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise RuntimeError(f"another writer has replaced version {before} of {self.path}")
        self.fs.create(self._path(f"{self.path}/current-{before + 1}-{folder}"), False).close()
        for old, at in self._pointers().items():
            if old < before:
                for gone in (f"current-{old}-{at}", at, f"claim-{old}"):
                    self.fs.delete(self._path(f"{self.path}/{gone}"), True)
        return before + 1
