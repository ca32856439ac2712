"""Exact k-means rounds with Drake's adaptive bounds.

Each vector carries an upper bound of the distance to its centroid, lower bounds of its distances to several of the
nearest others, each with the centroid's number, and one remainder bound for all that are farther. When centroids
move, bounds are widened by how far they moved. A vector keeps its centroid without any distance computed while the
upper bound is below all lower ones; else its distance is computed, and then those to the nearest others up to the first
from which on all lower bounds are above it. Where even the remainder bound isn't, the vector is scanned again in
full. How many lower bounds are carried follows how many the last round needed, an eighth of the centroids at least.

Distances are integers, and bounds are relaxed by more than a double's rounding, so a centroid is skipped only where it is
certainly farther: results are those of a full scan, ties (to the smaller number) included.

A round is one pass over the vectors, which are written with their bounds for the next; nothing is shuffled but sums. The
sums of centroids are kept on the driver as exact integers, k times the dimension of them, and only vectors that changed
their centroid count into the next. The driver gets nothing else but the k first vectors.

Vectors that are null, hold null or non-finite components, or have another dimension take no part. Repeated rows count
each. Rows without an id take part; they come last where first centroids are chosen, and equal hashes go by the vector.
With fewer vectors than k there are as many centroids; an empty table gives no rows. floor(scale * x) beyond a long is
the nearest long, and a squared distance beyond a long is returned as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, stored, table
from tessera.llm.pivot_search import quantised

#: Vectors that a task holds in expanded form at a time.
BATCH = 4096
#: Components up to this keep squared distances and a batch's sums inside 64 bits; others are computed in integers of
#: any length.
SMALL = 1 << 26
#: Relative and absolute widening of bounds: more than the rounding of square roots and sums.
WIDER, MORE = 1e-12, 1e-9
LONGEST = (1 << 63) - 1
STATE = "raw binary, cluster int, was int, upper double, nearest array<int>, lower array<double>, rest double, used int, computed long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``c``, exact: (n, d), (k, d) give (n, k), and (n, d), (n, k, d) too."""
    if x.dtype == object or max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > SMALL:
        x, c = x.astype(object), c.astype(object)
        if c.ndim == 2:
            return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), object)
        return ((x[:, None, :] - c) ** 2).sum(axis=2)
    if c.ndim == 2 and x.shape[1] * 4 * SMALL**2 < 1 << 62 and max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 * x.shape[1] < 1 << 51:
        a, b = x.astype(float), c.astype(float)  # whole numbers below 2^53, so products and sums are exact
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    if c.ndim == 2:
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)
    return ((x[:, None, :] - c) ** 2).sum(axis=2)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(float)) * (1 + WIDER) + MORE


def _below(d2: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.sqrt(d2.astype(float)) * (1 - WIDER) - MORE)


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, at least."""
    moved = ((old.astype(object) - new.astype(object)) ** 2).sum(axis=1).astype(float) if len(old) else np.zeros(0)
    return np.where(moved > 0, _above(moved), 0.0)


class Bounds:
    """The state of a batch of vectors: assignment, bounds, and what the last round took."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, nearest: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.x, self.cluster, self.upper, self.nearest, self.lower, self.rest = x, cluster, upper, nearest, lower, rest
        self.used, self.computed = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)

    @classmethod
    def scanned(cls, x: np.ndarray, centroids: np.ndarray, several: int) -> Bounds:
        n = len(x)
        out = cls(x, np.zeros(n, np.int64), np.zeros(n), np.zeros((n, several), np.int64), np.zeros((n, several)), np.zeros(n))
        out.scan(np.arange(n), centroids)
        return out

    def scan(self, at: np.ndarray, centroids: np.ndarray) -> None:
        """All distances of the rows ``at``."""
        several, k = self.nearest.shape[1], len(centroids)
        d2 = squared(self.x[at], centroids)
        order = np.argsort(d2, axis=1, kind="stable")  # equal distances stay by number
        sorted_ = np.take_along_axis(d2, order, axis=1)
        self.cluster[at], self.upper[at] = order[:, 0], _above(sorted_[:, 0])
        self.nearest[at], self.lower[at] = order[:, 1 : several + 1], _below(sorted_[:, 1 : several + 1])
        self.rest[at] = _below(sorted_[:, several + 1]) if k > several + 1 else np.inf
        self.used[at], self.computed[at] = several, k

    def narrowed(self, several: int) -> None:
        """Only ``several`` lower bounds are carried on; the remainder bound stands for the others."""
        if several < self.nearest.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, several:].min(axis=1))
            self.nearest, self.lower = self.nearest[:, :several].copy(), self.lower[:, :several].copy()

    def moved(self, by: np.ndarray) -> None:
        """Centroids have moved by at most ``by``."""
        self.upper = self.upper + by[self.cluster] * (1 + WIDER)
        self.lower = self.lower - by[self.nearest] * (1 + WIDER)
        self.rest = self.rest - by.max(initial=0) * (1 + WIDER)

    def assign(self, centroids: np.ndarray) -> None:
        """The nearest centroid of each row."""
        several = self.nearest.shape[1]
        # the least lower bound from each place on
        from_ = np.minimum.accumulate(np.hstack([self.lower, self.rest[:, None]])[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.upper >= from_[:, 0])
        if not len(open_):
            return
        own = squared(self.x[open_], centroids[self.cluster[open_]][:, None, :])[:, 0]
        self.upper[open_] = _above(own)
        self.computed[open_] = 1
        certain = self.upper[open_, None] < from_[open_]
        first = np.where(certain.any(axis=1), certain.argmax(axis=1), several + 1)
        self.scan(open_[first > several], centroids)
        for j in range(1, several + 1):
            pick = np.flatnonzero(first == j)
            if not len(pick):
                continue
            at = open_[pick]
            some = np.hstack([self.cluster[at, None], self.nearest[at, :j]])
            d2 = np.hstack([own[pick, None], squared(self.x[at], centroids[some[:, 1:]])])
            by_number = np.argsort(some, axis=1)
            some, d2 = np.take_along_axis(some, by_number, axis=1), np.take_along_axis(d2, by_number, axis=1)
            order = np.argsort(d2, axis=1, kind="stable")
            some, d2 = np.take_along_axis(some, order, axis=1), np.take_along_axis(d2, order, axis=1)
            self.cluster[at], self.upper[at] = some[:, 0], _above(d2[:, 0])
            self.nearest[at, :j], self.lower[at, :j] = some[:, 1:], _below(d2[:, 1:])
            self.used[at], self.computed[at] = j, j + 1


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _sums(x: np.ndarray, cluster: np.ndarray, sign: int, into: dict[int, list]) -> None:
    for c in np.unique(cluster):
        part = x[cluster == c]
        total = (part.astype(object) if np.abs(part).max(initial=0) > SMALL else part).sum(axis=0)
        held = into.setdefault(int(c), [0, np.zeros(x.shape[1], object)])
        held[0] += sign * len(part)
        held[1] = held[1] + sign * total.astype(object)


def clusters(
    df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", bounds: int | None = None, tally: list | None = None
) -> DataFrame:
    """``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid`` (array<long>) of
    each vector, after ``rounds`` rounds of assignment and mean, and one more assignment.

    First centroids are the vectors with the smallest ``seed``, by default the hex sha256 of ``1:<id>``. A mean is the
    floor of the exact quotient. ``bounds``: how many lower bounds to begin with, by default a quarter of k. ``tally``, if
    given, gets a dict for each round: how many distances were computed, of how many, and how many vectors moved.
    """
    spark = df.sparkSession
    key = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256) if seed is None else seed
    rows = quantised(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector", scale).where(F.size("v") == dim)
    first = rows.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()  # k rows
    id_type = rows.schema["id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    several = max(1, min(k - 1, -(-k // 4) if bounds is None else bounds)) if k > 1 else 0
    least = min(several, -(-k // 8))
    schema = T._parse_datatype_string(f"id {id_type}, {STATE}")

    def written(b: Bounds, ids: pa.Array, raw: pa.Array, was: np.ndarray) -> pa.RecordBatch:
        n, width = b.nearest.shape
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))
        columns = [ids, raw, pa.array(b.cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(b.upper), lists(b.nearest, pa.int32()), lists(b.lower, pa.float64()), pa.array(b.rest), pa.array(b.used, pa.int32()), pa.array(b.computed)]
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def begin(centroids: np.ndarray, several: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, len(whole), BATCH):
                    part = whole.slice(i, BATCH)
                    x = np.asarray(part.column(1).flatten()).reshape(-1, dim).astype("<i8")
                    raw = pa.array([r.tobytes() for r in x], pa.binary())
                    yield written(Bounds.scanned(x, centroids, several), part.column(0), raw, np.full(len(x), -1))

        return run

    def onward(centroids: np.ndarray, by: np.ndarray, several: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, len(whole), BATCH):
                    part = whole.slice(i, BATCH)
                    column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                    n = len(part)
                    was = np.array(column("cluster"), np.int64)
                    lists = lambda name: np.array(column(name).flatten()).reshape(n, -1)  # noqa: B023, E731
                    b = Bounds(_vectors(column("raw"), dim), was.copy(), np.array(column("upper")), lists("nearest").astype(np.int64), lists("lower").astype(float), np.array(column("rest")))
                    b.narrowed(several)
                    b.moved(by)
                    b.assign(centroids)
                    yield written(b, column("id"), column("raw"), was)

        return run

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What vectors that moved add to, and take from, counts and sums."""
        into: dict[int, list] = {}
        for batch in batches:
            x, now, was = _vectors(batch.column(0), dim), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            _sums(x, now, 1, into)
            _sums(x[was >= 0], was[was >= 0], -1, into)
        cells = [(c, i, v) for c, (n, total) in into.items() for i, v in enumerate([n, *total.tolist()])]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([str(c[2]) for c in cells], pa.string())], names=["cluster", "part", "value"])

    counts, sums = [0] * k, np.zeros((k, dim), object)
    state = stored(rows.select("id", "v").mapInArrow(begin(centroids, several), schema), "bounds")
    for r in range(rounds):
        moved = state.where("cluster <> was").select("raw", "cluster", "was").mapInArrow(changes, "cluster int, part int, value string")
        for row in moved.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # k * (dim + 1) rows
            if row.part == 0:
                counts[row.cluster] += int(row.value)
            else:
                sums[row.cluster, row.part - 1] += int(row.value)
        old = centroids
        centroids = np.array([[s // counts[c] for s in sums[c]] if counts[c] else old[c].tolist() for c in range(k)], np.int64)
        need = state.agg(F.max("used").alias("used"), F.sum("computed").alias("computed"), F.count("*").alias("n"), F.sum((F.col("cluster") != F.col("was")).cast("long")).alias("moved")).first()
        if tally is not None:
            tally.append({"computed": need.computed, "of": need.n * k, "moved": need.moved, "bounds": several})
        if r:  # the first scan says nothing about what bounds are good for
            several = max(least, min(several, need.used))
        after = stored(state.mapInArrow(onward(centroids, drift(old, centroids), several), schema), "bounds")
        discard(state)
        state = after
    if tally is not None:
        need = state.agg(F.sum("computed").alias("computed"), F.count("*").alias("n"), F.sum((F.col("cluster") != F.col("was")).cast("long")).alias("moved")).first()
        tally.append({"computed": need.computed, "of": need.n * k, "moved": need.moved, "bounds": several})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), BATCH):
                part = whole.slice(i, BATCH)
                own = np.asarray(part.column(2))
                d2 = squared(_vectors(part.column(1), dim), centroids[own][:, None, :])[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([min(int(d), LONGEST) for d in d2], pa.int64())], names=["id", "cluster", "distance"])

    found = stored(state.select("id", "raw", "cluster").mapInArrow(last, f"id {id_type}, cluster int, distance long"), "clusters")
    discard(state)
    totals = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    inertia = min(sum(totals.values()), LONGEST)
    of = spark.createDataFrame([(c, min(t, LONGEST), inertia, centroids[c].tolist()) for c, t in sorted(totals.items())], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(of), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    """16 clusters of all vectors of 64 components, after 3 rounds, with inertia and digests of the centroids."""
    out = clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _rounds_sql(rounds: int) -> str:
    """Assignments a0, a1, ... and centroids c0, c1, ..., in DuckDB SQL over ``x`` (row number r, d, x)."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""s{i} AS (SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d2 FROM x JOIN c{i} c ON x.d = c.d GROUP BY x.r, c.c),
a{i} AS (SELECT r, c, d2 FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d2, c) AS n FROM s{i}) WHERE n = 1)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT a.c, x.d, sum(x.x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} a JOIN x ON x.r = a.r GROUP BY a.c, x.d),
c{i + 1} AS (SELECT c.c, c.d, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c AND c.d = m.d)""")
    return ",\n".join(parts)


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) AS r FROM v),
x AS (SELECT r, unnest(range(64)) AS d, unnest(v) AS x FROM w),
c0 AS (SELECT r - 1 AS c, d, x FROM x WHERE r <= 16),
{_rounds_sql(3)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT w.vec_id, a.c::INTEGER AS cluster, a.d2::BIGINT AS distance, (sum(a.d2) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d2) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a3 a JOIN w ON w.r = a.r JOIN h ON h.c = a.c
"""
