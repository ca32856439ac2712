"""Vector, lexical and hybrid search over stored vectors.

Filters come before ranking. One query is a distributed top-n; many queries meet the store in blocks, and each task
keeps the best n of a query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.session import written

#: Queries, and rows of the store, that a task compares at a time.
BLOCK, STORE_BLOCK = 256, 1024


def top_k(store: DataFrame, query: Sequence[float], k: int, where: Column | None = None, vector: str = "embedding", tie: Sequence[str] = ("vec_id",)) -> DataFrame:
    """The k rows nearest to the query among those that meet the condition, with distance and score."""
    rows = store if where is None else store.where(where)
    found = rows.withColumn("distance", vx.l2_distance(F.col(vector), vx.literal(list(query))))
    return found.withColumn("score", vx.score_of(F.col("distance"))).orderBy("distance", *tie).limit(k)


def min_score(found: DataFrame, least: float | None) -> DataFrame:
    """Hits of at least a score; applied to a top k it may leave fewer than k."""
    return found if least is None else found.where(F.col("score") >= least)


def top_k_each(store: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", tie: str = "vec_id", same: str | None = None, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of each query: query_id, the tie column, distance, score and rank.

    ``queries`` (query_id, query_vector and, if ``same`` is given, that column) meet the store in blocks, by a join of
    blocks: query blocks are rows of up to ``block`` queries, written once; store blocks, made where their rows
    are, of up to ``STORE_BLOCK``. Each pair of blocks is a task's product of matrices, of which k hits of a query are kept
    before anything is shuffled. Nothing of it passes the driver. With ``same`` a row meets only queries
    with an equal value in that column. Null vectors, those with nulls and those of another length take no part.
    """
    own = F.col(same).cast("string") if same else F.lit("")
    whole = lambda c: c.isNotNull() & ~F.exists(c, lambda x: x.isNull())
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v"), own.alias("same")).where(whole(F.col("v")) & F.col("same").isNotNull())
    rows = store.select(tie, F.col(vector).cast("array<double>").alias("v"), own.alias("same")).where(whole(F.col("v")) & F.col("same").isNotNull())
    asked_blocks = written(_blocks(asked, "query_id", block), "queries").withColumnsRenamed({"ids": "q_ids", "raw": "q_raw"})
    store_blocks = _blocks(rows, tie, STORE_BLOCK)
    hits = T.StructType([asked.schema["query_id"], rows.schema[tie], T.StructField("distance", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                size, q_ids, q_raw, ids, raw = (batch.column(i)[n] for i in range(5))
                asking, found = q_ids.values, ids.values
                q, m = (np.frombuffer(x.as_buffer(), float).reshape(len(y), size.as_py()) for x, y in ((q_raw, asking), (raw, found)))
                at, near, far = [], [], []
                for i, one in enumerate(q):
                    d = np.sqrt(((m - one) ** 2).sum(axis=1))
                    kept = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                    at += [i] * len(kept)
                    near += kept.tolist()
                    far.append(d[kept])
                arrays = [asking.take(pa.array(at, pa.int64())), found.take(pa.array(near, pa.int64())), pa.array(np.concatenate(far) if far else [], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=hits.fieldNames())

    met = store_blocks.join(asked_blocks, ["size", "same"]).select("size", "q_ids", "q_raw", "ids", "raw")
    found = met.mapInArrow(nearest, hits)
    w = Window.partitionBy("query_id").orderBy("distance", tie)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", vx.score_of(F.col("distance")))


def _blocks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (key, v, same) as blocks of up to ``most`` vectors of one length and ``same``: size, same, ids, raw, gathered
    where they are."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list]] = {}
        for batch in batches:
            for i, v, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                at = (len(v), same)
                ids, raw = held.setdefault(at, ([], []))
                ids.append(i.as_py())
                raw.append(np.asarray(v.values).tobytes())
                if len(ids) == most:
                    yield block(at, *held.pop(at))
        for at, x in held.items():
            yield block(at, *x)

    def block(at: tuple, ids: list, raw: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.string()), pa.array([ids], id_type), pa.array([b"".join(raw)], pa.binary())], names=["size", "same", "ids", "raw"])

    id_type = to_arrow_schema(T.StructType([T.StructField("ids", T.ArrayType(rows.schema[key].dataType))])).field(0).type
    return rows.select(key, "v", "same").mapInArrow(run, f"size int, same string, ids array<{kind}>, raw binary")


def lexical_score(text_tokens: Column, query_tokens: Column, require_all: bool = False) -> Column:
    """Share of the query's distinct terms that a text has; with ``require_all`` 0 unless it has all."""
    hit = F.size(F.array_intersect(text_tokens, query_tokens)) / F.greatest(F.size(query_tokens), F.lit(1))
    return F.when(hit < 1, F.lit(0.0)).otherwise(hit) if require_all else hit


def lexical_top_k(docs: DataFrame, query: str, k: int, text: str = "text", tie: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The k texts with the largest lexical score above 0."""
    rank = lexical_score(tx.search_tokens(F.col(text)), tx.search_tokens(F.lit(query)))
    return docs.withColumn("lexical", rank).where("lexical > 0").orderBy(F.desc("lexical"), *tie).limit(k)


def hybrid_top_k(store: DataFrame, query: str, vector: Sequence[float], k: int, where: Column | None = None, weights: tuple[float, float] = (0.7, 0.3), tie: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The k best by weighted distance less weighted lexical score; the returned score is by distance alone."""
    rows = store if where is None else store.where(where)
    found = rows.withColumns({"distance": vx.l2_distance(F.col("embedding"), vx.literal(list(vector))), "lexical": lexical_score(tx.search_tokens(F.col("text")), tx.search_tokens(F.lit(query)))})
    ranked = found.withColumn("hybrid", vx.hybrid_rank(F.col("distance"), F.col("lexical"), *weights))
    return ranked.orderBy("hybrid", *tie).limit(k).withColumn("score", vx.score_of(F.col("distance")))


def cascade(stages: Sequence[DataFrame], least: float = 0.15) -> DataFrame:
    """For each query the hits of the first stage that has one of at least the score; query_id and score are needed.

    All stages are one plan and each is computed once: a window over a query's hits finds the least stage accepted.
    """
    union = None
    for n, stage in enumerate(stages):
        part = stage.withColumn("stage", F.lit(n))
        union = part if union is None else union.unionByName(part)
    taken = F.min(F.when(F.col("score") >= least, F.col("stage"))).over(Window.partitionBy("query_id"))
    return union.withColumn("_taken", taken).where("stage = _taken").drop("_taken")


def single_cascade(stages: Sequence, least: float = 0.15) -> DataFrame:
    """The hits of the first stage that has one of at least the score; stages are made only when they are needed."""
    found = None
    for make in stages:
        found = make()
        if not found.where(F.col("score") >= least).limit(1).isEmpty():
            return found
    return found.limit(0)


def first_metadata(store: DataFrame) -> DataFrame:
    """Each object's metadata, as its first chunk has it."""
    return store.groupBy("object_type", "object_id").agg(F.min_by("metadata", "chunk_index").alias("metadata"))
