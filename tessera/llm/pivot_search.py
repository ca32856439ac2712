"""Exact top-k inner-product search with a pivot-distance index.

Vectors get one more coordinate, so that all have the same norm; then the largest inner product is the smallest
Euclidean distance, for which the triangle inequality holds. Each vector is keyed by its nearest pivot and its
distance to it; the index holds the vectors of a pivot in annuli, blocks of consecutive distances. A block of queries
expands the annuli in the order of their lower bounds |d(q, pivot) - r| and stops at the first that no query of the
block can gain from, given its k-th best score so far. First scores come from the annuli nearest to the query block.

Pivots come from a bounded sample; everything else covers all rows. Query blocks meet index blocks only where the
bound allows it, in slices of a bounded number of blocks that any task can take. Bounds are relaxed by more than a
double's rounding, and scores are integers, so results are exact, ties included (to the smaller id).

Vectors that are null, or hold null or non-finite components, take no part; neither do rows without an id. Vectors
are compared within their dimension. Repeated rows are candidates each on its own, other than rows with the query's
id; of several rows with a query's id the one of the smallest vector asks. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

#: Rows the pivots are chosen from, pivots, vectors of an annulus, queries of a block, annuli of a slice.
SAMPLE, PIVOTS, ANNULUS, QUERY_BLOCK, SLICE = 2048, 16, 2048, 512, 32
#: Inner products stay exact in a double below this; beyond it they are computed in 64-bit integers.
EXACT = 2.0**52
#: Share of the largest squared norm that rounding of doubles may add to or take from a squared distance.
ROUNDING = 1e-14


def quantised(df: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """``v`` array<long>: floor(scale * x) of each component, for vectors that are whole and finite."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(x.isNotNull() & ~odd).withColumn("v", F.transform(x, lambda c: F.floor(c * scale)))


def _farthest(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots by farthest-first choice from the sample."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)


def build_index(vectors: DataFrame, pivots: dict[int, np.ndarray], top: dict[int, float], kind: str, annulus: int = ANNULUS) -> DataFrame:
    """Blocks of the index from (vec_id, dim, v): dim, pivot, nearest and farthest distance, the block's ids, and its
    vectors as bytes of the integer type ``kind``. ``top``: each dimension's largest squared norm."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, v = batch.column(0), np.asarray(batch.column(1)), batch.column(2)
            pivot, distance, raw = np.zeros(len(dims), np.int32), np.zeros(len(dims)), [b""] * len(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(v.take(pa.array(at)), int(d)) if d else np.zeros((len(at), 0))
                lift = np.sqrt(np.maximum(0, top[int(d)] - (x * x).sum(axis=1)))
                full = np.hstack([x, lift[:, None]])
                p = pivots[int(d)]
                square = (full * full).sum(axis=1)[:, None] - 2 * full @ p.T + (p * p).sum(axis=1)
                near = square.argmin(axis=1)
                pivot[at], distance[at] = near, np.sqrt(((full - p[near]) ** 2).sum(axis=1))
                for i, row in zip(at.tolist(), x.astype(kind), strict=True):
                    raw[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(pivot), pa.array(distance), pa.array(raw, pa.binary())], names=["vec_id", "dim", "pivot", "distance", "raw"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ring = [], None

        def close() -> pa.RecordBatch:
            r = [x[2] for x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([ring[0]], pa.int32()), pa.array([ring[1]], pa.int32()), pa.array([min(r)]), pa.array([max(r)]), pa.array([len(held)], pa.int32())]
                + [pa.array([[x[0] for x in held]], pa.list_(pa.int64())), pa.array([b"".join(x[1] for x in held)])],
                names=["dim", "pivot", "low", "high", "n", "ids", "raw"],
            )

        for batch in batches:
            for i, d, p, r, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((d, p) != ring or len(held) == annulus):
                    yield close()
                    held = []
                ring = (d, p)
                held.append((i, raw, r))
        if held:
            yield close()

    placed = vectors.select("vec_id", "dim", "v").mapInArrow(place, "vec_id long, dim int, pivot int, distance double, raw binary")
    ordered = placed.repartitionByRange("dim", "pivot", "distance", "vec_id").sortWithinPartitions("dim", "pivot", "distance", "vec_id")
    out = ordered.mapInArrow(blocks, "dim int, pivot int, low double, high double, n int, ids array<long>, raw binary")
    return out.withColumn("block", F.xxhash64("dim", "pivot", "low", "high", "ids"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score down, id up)."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(df: DataFrame, queries: F.Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for every row that ``queries`` holds for, the k other
    rows of the largest integer inner products of floor(scale * x)."""
    spark = df.sparkSession
    rows = quantised(df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null"), "vector", scale)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("v").alias("dim"), "v")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    most = rows.groupBy("dim").agg(F.max(square).alias("top"), F.max(F.array_max(F.transform("v", F.abs))).alias("part")).collect()  # a row per dimension
    top = {r.dim: float(r.top) for r in most}
    part = max([r.part or 0 for r in most], default=0)
    kind = next(t for t, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 63)) if part < 1 << bits)
    whole = any(x >= EXACT for x in top.values())
    number, least = ("<i8", -(1 << 63)) if whole else ("<f8", -np.inf)
    pivots = {}
    for dim, largest in top.items():
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0)
        x = _matrix(sample.combine_chunks(), dim) if dim else np.zeros((1, 0))
        pivots[dim] = _farthest(np.hstack([x, np.sqrt(np.maximum(0, largest - (x * x).sum(axis=1)))[:, None]]), PIVOTS)
    index = stored(build_index(rows, pivots, top, kind), "index")
    asking = rows.where(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*")
    own = stored(build_index(asking, pivots, top, kind, QUERY_BLOCK), "queries").select(
        F.col("dim"), F.col("pivot").alias("q_pivot"), F.col("ids").alias("q_ids"), F.col("raw").alias("q_raw"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("block").alias("q_block")
    )
    annuli = index.select("dim", "pivot", "low", "high", "n", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Annuli of a query block and slice follow each other by lower bound."""
        state = None

        def flush() -> pa.RecordBatch:
            _, q, _, best = state
            n = [len(b[0]) for b in best]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q, n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]).astype(np.int64))], names=["query_id", "vec_id", "score"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                mark, dim = (row["q_block"], row["slice"]), row["dim"]
                if state is None or state[0] != mark:
                    if state:
                        yield flush()
                    q = np.array(row["q_ids"], np.int64)
                    none = (np.empty(0, np.int64), np.empty(0, number))
                    floor = np.frombuffer(row["floor"], number) if row["floor"] else np.full(len(q), least, number)
                    x = np.frombuffer(row["q_raw"], kind).reshape(len(q), dim).astype(number)
                    state = (mark, q, (x, (x.astype(float) ** 2).sum(axis=1), floor.copy()), [none] * len(q))
                _, q, (x, square, floor), best = state
                # |q|^2 + M - 2 s >= bound^2 for every s in the annulus
                reach = (square + top[dim] - row["bound"] ** 2) / 2
                open_ = np.flatnonzero(reach + 1e-6 * (1 + abs(reach)) + ROUNDING * top[dim] >= floor)
                if not len(open_):
                    continue
                ids = np.array(row["ids"], np.int64)
                scores = x[open_] @ np.frombuffer(row["raw"], kind).reshape(len(ids), dim).astype(number).T
                for i, s in zip(open_.tolist(), scores, strict=True):
                    may = np.flatnonzero((s >= floor[i]) & (ids != q[i]))
                    if not len(may):
                        continue
                    all_ids, all_scores = np.concatenate([best[i][0], ids[may]]), np.concatenate([best[i][1], s[may]])
                    at = _best(all_ids, all_scores, k)
                    best[i] = (all_ids[at], all_scores[at])
                    if len(at) == k:
                        floor[i] = max(floor[i], best[i][1][-1])
        if state:
            yield flush()

    def searched(pairs: DataFrame) -> DataFrame:
        """Scores of paired blocks. The pairs carry the queries; an annulus is fetched once for each pair."""
        taken = pairs.join(index.select("block", "ids", "raw"), "block")
        return taken.repartition("q_block", "slice").sortWithinPartitions("q_block", "slice", "bound", "block").mapInArrow(scan, "query_id long, vec_id long, score long")

    # First scores: the annulus of the queries' own pivot that is nearest to the block.
    met = own.select("dim", F.col("q_pivot").alias("pivot"), "q_block", "q_low", "q_high").join(annuli, ["dim", "pivot"])
    away = F.greatest(F.lit(0.0), F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"))
    near = met.groupBy("q_block").agg(F.min(F.struct(away.alias("away"), "block")).alias("x"))
    seeds = near.select("q_block", "x.block").join(own, "q_block")
    first = searched(seeds.select("dim", "q_block", "q_ids", "q_raw", "block", F.lit(0).alias("slice"), F.lit(0.0).alias("bound"), F.lit(None).cast("binary").alias("floor")))
    kth = stored(first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("kth")), "first")

    # Bounds of a query block to each pivot: its queries' smallest and largest distance, and what they may still gain.
    floors = own.select("q_block", F.posexplode("q_ids").alias("i", "query_id")).join(kth, "query_id", "left")
    floors = floors.groupBy("q_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kth"))), lambda r: r["kth"]).alias("kths"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, n = row["dim"], len(row["q_ids"])
                x = np.frombuffer(row["q_raw"], kind).reshape(n, dim).astype(float)
                floor = np.array([least if s is None else s for s in row["kths"]], number)
                p, off = pivots[dim], np.sqrt(ROUNDING * top[dim])
                full = np.hstack([x, np.zeros((n, 1))])
                d = np.sqrt(np.maximum(0, (full * full).sum(axis=1)[:, None] - 2 * full @ p.T + (p * p).sum(axis=1)))
                radius = np.sqrt(np.maximum(0, (x * x).sum(axis=1) + top[dim] * (1 + ROUNDING) - 2 * floor.astype(float))) + off
                m = len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]] * m), pa.array([dim] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(d.min(axis=0) - off), pa.array(d.max(axis=0) + off)]
                    + [pa.array((d - radius[:, None]).min(axis=0) - off), pa.array((d + radius[:, None]).max(axis=0) + off), pa.array([floor.tobytes()] * m)],
                    names=["q_block", "dim", "pivot", "d_low", "d_high", "inner", "outer", "floor"],
                )

    ranges = own.join(floors, "q_block").select("q_block", "dim", "q_ids", "q_raw", "kths").mapInArrow(reach, "q_block long, dim int, pivot int, d_low double, d_high double, inner double, outer double, floor binary")
    slack = 1e-6
    pairs = ranges.join(annuli, ["dim", "pivot"]).where((F.col("high") >= F.col("inner") - slack * (1 + F.abs("inner"))) & (F.col("low") <= F.col("outer") + slack * (1 + F.abs("outer"))))
    bound = F.greatest(F.lit(0.0), (F.col("low") - F.col("d_high")) * (1 - slack) - slack, (F.col("d_low") - F.col("high")) * (1 - slack) - slack)
    blocks = index.count()
    slices = max(1, -(-blocks // SLICE))
    pairs = pairs.select("q_block", "block", "floor", bound.alias("bound"), F.pmod("block", F.lit(slices)).cast("int").alias("slice")).join(own.select("dim", "q_block", "q_ids", "q_raw"), "q_block")
    found = searched(pairs)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
