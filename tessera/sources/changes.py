"""A keyed table that takes changes without being rewritten: merge on read.

The table lies in a base, dealt into buckets by a hash of the key, and in changes behind it. A change of m keys writes m
rows: upserted ones, or the keys alone of deleted ones; a change of scopes writes the scopes' values. A read takes the
base's rows whose key or scope no later change names, and of each key the latest change; buckets that no change touches
are read as they are. ``compact`` writes the merged rows as a new base.

Commits are a log of folders, one for each version, that come into being whole: data first, then a manifest in a folder of
its own, which is renamed to the version's name. Only one writer's rename can make that name; the other's manifest ends up
inside it, where nobody looks, so that writer knows it has lost and takes the next version. A writer that dies leaves
either a whole version or files that no version names (``vacuum`` removes them), and never a lock. The file system must
rename folders atomically, as HDFS and local ones do.

Of several rows of one key in a change the last by a given order counts (``store.one_each``). Nulls in keys are a value
like any other. A version that was read stays readable until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import KEY, one_each


class ChangeStore:
    """``key`` names a row, ``scope`` (some of the key's columns) a set of rows that is deleted or replaced together."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = KEY, scope: Sequence[str] = KEY[:2], buckets: int = 16):
        self.spark, self.path, self.key, self.scope, self.buckets = spark, path.rstrip("/"), list(key), list(scope), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # The log

    def version(self) -> int:
        """The latest version, -1 for none."""
        return max(self._versions(), default=-1)

    def _versions(self) -> list[int]:
        at = self._path(f"{self.path}/log")
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _manifest(self, version: int) -> dict:
        files = [s.getPath() for s in self.fs.listStatus(self._path(f"{self.path}/log/{version:012d}")) if s.isFile() and s.getPath().getName().endswith(".json")]
        stream = self.fs.open(files[0])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def history(self, version: int | None = None) -> list[dict]:
        """The manifests that a version is made of: its base and the changes behind it, in order."""
        out: list[dict] = []
        for v in reversed([v for v in self._versions() if version is None or v <= version]):
            out.append({**self._manifest(v), "version": v})
            if out[-1]["kind"] == "base":
                break
        if not out or (version is not None and out[0]["version"] != version):
            raise FileNotFoundError(f"{self.path} has no version {version if version is not None else 'yet'}")
        return out[::-1]

    def _step(self, name: str) -> None:
        """What a commit has come to; tests make writers die here."""

    def _commit(self, manifest: dict, of: int | None) -> int:
        """Makes the manifest the next version; with ``of`` only if that is still the latest."""
        self._step("data")
        name = uuid.uuid4().hex
        while True:
            latest = self.version()
            if of is not None and latest != of:
                raise RuntimeError(f"another writer has replaced version {of} of {self.path}")
            own, target = f"{self.path}/tmp/{name}", f"{self.path}/log/{latest + 1:012d}"
            out = self.fs.create(self._path(f"{own}/{name}.json"), True)
            out.write(bytearray(json.dumps(manifest).encode()))
            out.close()
            self._step("manifest")
            self.fs.mkdirs(self._path(f"{self.path}/log"))
            self.fs.rename(self._path(own), self._path(target))
            self._step("renamed")
            if self.fs.exists(self._path(f"{target}/{name}.json")):
                return latest + 1
            self.fs.delete(self._path(f"{target}/{name}"), True)  # another writer was first: ours is inside its folder

    # Writes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _buckets_of(self, folder: str) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/{folder}")))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("_bucket="))

    def create(self, df: DataFrame, order: Column | None = None) -> int:
        """The first version."""
        return self._commit({"kind": "base", "folder": self._write(one_each(df, self.key, order, True)), "schema": df.schema.json()}, -1)

    def _change(self, rows: DataFrame, scopes: DataFrame | None, of: int | None) -> int:
        folder = self._write(rows)
        manifest = {"kind": "change", "folder": folder, "buckets": self._buckets_of(folder)}
        if scopes is not None:
            manifest["scopes"] = f"scopes/{uuid.uuid4().hex}"
            scopes.select(*self.scope).distinct().write.parquet(f"{self.path}/{manifest['scopes']}")
        return self._commit(manifest, of)

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.history()[0]["schema"]))

    def _upserts(self, new: DataFrame, order: Column | None) -> DataFrame:
        return one_each(new, self.key, order, True).select(*self._schema().fieldNames(), F.lit(False).alias("_gone"))

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*self._schema().fields, T.StructField("_gone", T.BooleanType())]))

    def upsert(self, new: DataFrame, order: Column | None = None, of: int | None = None) -> int:
        """Rows of the change take the place of those with their keys."""
        return self._change(self._upserts(new, order), None, of)

    def delete_keys(self, keys: DataFrame, of: int | None = None) -> int:
        """The rows with these keys go."""
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema().fields if f.name not in self.key]
        gone = keys.select(*self.key).distinct().select(*self.key, *rest).select(*self._schema().fieldNames(), F.lit(True).alias("_gone"))
        return self._change(gone, None, of)

    def delete_scopes(self, scopes: DataFrame, of: int | None = None) -> int:
        """All rows of these scopes go."""
        return self._change(self._nothing(), scopes, of)

    def replace_scopes(self, new: DataFrame, order: Column | None = None, scopes: DataFrame | None = None, of: int | None = None) -> int:
        """All rows of the change's scopes (or of ``scopes``) give way to the change, in one version."""
        return self._change(self._upserts(new, order), new if scopes is None else scopes, of)

    def insert_missing(self, new: DataFrame, order: Column | None = None) -> int:
        """Rows of the change whose key isn't there; another writer's commit meanwhile makes it fail, as keys may be there
        since."""
        before = self.version()
        own = one_each(new, self.key, order, False)
        there = self.read_keys(own.select(*self.key), before)
        missing = own.join(there.select(*self.key), self._same(own, there), "left_anti")
        return self._change(missing.select(*self._schema().fieldNames(), F.lit(False).alias("_gone")), None, before)

    def compact(self) -> int:
        """The latest version as a new base, if no other writer has committed meanwhile."""
        before = self.version()
        return self._commit({"kind": "base", "folder": self._write(self.read(before)), "schema": self._schema().json()}, before)

    def vacuum(self, older_than_s: float = 0) -> int:
        """Removes what no version since the latest base names, and versions before that base; how many folders went. Files
        younger than ``older_than_s`` stay, as a writer may still be about to name them, or a reader to read them."""
        since = self.history()
        named = {m[k] for m in since for k in ("folder", "scopes") if k in m}
        until, gone = time.time() * 1000 - older_than_s * 1000, 0
        for kind in ("data", "scopes", "tmp", "log"):
            at = self._path(f"{self.path}/{kind}")
            for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
                name = s.getPath().getName()
                kept = int(name) >= since[0]["version"] if kind == "log" else f"{kind}/{name}" in named
                if not kept and s.getModificationTime() <= until:
                    self.fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    # Reads

    def _same(self, a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> Column:
        out = F.lit(True)
        for c in columns or self.key:
            out = out & a[c].eqNullSafe(b[c])
        return out

    def _table(self, manifest: dict, change: bool) -> DataFrame:
        fields = [*self._schema().fields, *([T.StructField("_gone", T.BooleanType())] if change else []), T.StructField("_bucket", T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/{manifest['folder']}")

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the latest unless given; ``buckets``: only these are read."""
        base, *changes = self.history(version)
        names = self._schema().fieldNames()
        within = lambda df: df if buckets is None else df.where(F.col("_bucket").isin([int(b) for b in buckets]))
        rows = within(self._table(base, False))
        if not changes:
            return rows.select(*names)
        every = scopes = None
        for m in changes:
            part = within(self._table(m, True)).withColumn("_v", F.lit(m["version"]))
            every = part if every is None else every.unionByName(part)
            if "scopes" in m:
                part = self.spark.read.schema(T.StructType([self._schema()[c] for c in self.scope])).parquet(f"{self.path}/{m['scopes']}").withColumn("_since", F.lit(m["version"]))
                scopes = part if scopes is None else scopes.unionByName(part)
        if scopes is not None:
            scopes = scopes.groupBy(*self.scope).agg(F.max("_since").alias("_since"))
            same = self._same(rows, scopes, self.scope)
            rows = rows.join(scopes, same, "left_anti")
            every = every.join(scopes, self._same(every, scopes, self.scope) & (every["_v"] < scopes["_since"]), "left_anti")
        rest = [c for c in names if c not in self.key]
        last = every.groupBy(*self.key, "_bucket").agg(F.max_by(F.struct("_gone", *rest), "_v").alias("_row"))
        touched = sorted({b for m in changes for b in m["buckets"]})
        apart = rows.where(~F.col("_bucket").isin(touched)) if touched else rows
        met = rows.where(F.col("_bucket").isin(touched)) if touched else rows.limit(0)
        left = met.join(last, self._same(met, last, ["_bucket", *self.key]), "left_anti")
        now = last.where("not _row._gone").select(*self.key, *(F.col("_row")[c].alias(c) for c in rest))
        return apart.select(*names).unionByName(left.select(*names)).unionByName(now.select(*names))

    def read_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows with these keys; only the keys' buckets are read."""
        own = keys.select(*self.key).distinct()
        wanted = [r._bucket for r in own.select(self._bucket().alias("_bucket")).distinct().collect()]  # as many as there are buckets
        rows = self.read(version, wanted)
        return rows.join(own, self._same(rows, own), "left_semi")
