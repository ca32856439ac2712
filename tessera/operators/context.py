"""Context of hits: neighbours, siblings, sections, and packing into a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

MAX_CHUNKS, MAX_CHARS = 8, 12_000


def neighbours(hits: DataFrame, chunks: DataFrame, hops: int = 1, scope: tuple[str, ...] = ("object_type", "object_id")) -> DataFrame:
    """The chunks up to ``hops`` links before and after each hit, hits included, each once for a hit.

    hits: hit_id, scope, chunk_id. Links are followed one hop at a time by equi-joins, so missing links, and links
    that lead back, end a walk of their own accord: a hit's chunk is kept once, at its least distance.
    """
    key = [*scope, "chunk_id"]
    links = chunks.select(*key, F.explode(F.array("prev_chunk_id", "next_chunk_id")).alias("to")).where("to is not null")
    seen = hits.select("hit_id", *key).withColumn("away", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = front.join(links, key).select("hit_id", *scope, F.col("to").alias("chunk_id")).distinct().withColumn("away", F.lit(hop))
        front = front.join(chunks.select(*key), key, "left_semi")
        seen = seen.unionByName(front)
    return seen.groupBy("hit_id", *key).agg(F.min("away").alias("away"))


def single(hits: DataFrame, chunks: DataFrame, scope: tuple[str, ...] = ("object_type", "object_id")) -> bool:
    """If each hit has one chunk and each chunk one row. What their joins give is distinct then as it is; to make it so
    would hold all of it in the tasks' memory. Keys alone are moved to tell."""
    repeated = lambda df, *key: not df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return not repeated(hits, "hit_id", *scope) and not repeated(chunks, *scope, "chunk_id")


def siblings(hits: DataFrame, chunks: DataFrame, by: str, scope: tuple[str, ...] = ("object_type", "object_id"), once: bool | None = None) -> DataFrame:
    """The chunks that share the hit's value of ``by`` (a parent or a section) in its object, hits included. ``once``: what
    ``single`` says, if it is known."""
    own = hits.join(chunks.select(*scope, "chunk_id", by), [*scope, "chunk_id"]).select("hit_id", *scope, "chunk_id", by)
    others = own.where(f"{by} is not null and {by} <> ''").select("hit_id", *scope, by).join(chunks.select(*scope, "chunk_id", by), [*scope, by]).select("hit_id", *scope, "chunk_id")
    if single(hits, chunks, scope) if once is None else once:  # others hold the hit's own chunk, unless it has no value
        return others.unionByName(own.where(f"{by} is null or {by} = ''").select("hit_id", *scope, "chunk_id"))
    return others.unionByName(own.select("hit_id", *scope, "chunk_id")).distinct()


def expanded(hits: DataFrame, chunks: DataFrame, hops: int = 1) -> DataFrame:
    """Each hit by the way its chunk prefers: a table stays alone, then its parent's chunks, then its section's, else
    its neighbours."""
    scope = ("object_type", "object_id")
    once = single(hits, chunks, scope)
    own = hits.join(chunks.select(*scope, "chunk_id", "chunk_type", "parent_chunk_id", "section"), [*scope, "chunk_id"])
    base = own.select("hit_id", *scope, "chunk_id", "chunk_type", "parent_chunk_id", "section")
    way = F.when(F.col("chunk_type") == "table", "table").when(F.col("parent_chunk_id").isNotNull(), "parent").when(F.coalesce("section", F.lit("")) != "", "section").otherwise("window")
    routed = base.withColumn("way", way)
    pick = lambda w: routed.where(F.col("way") == w).select("hit_id", *scope, "chunk_id")
    parts = [pick("table"), siblings(pick("parent"), chunks, "parent_chunk_id", once=once), siblings(pick("section"), chunks, "section", once=once), neighbours(pick("window"), chunks, hops).drop("away")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if once else out.distinct()


def packed(hits: DataFrame, group: str, order: list, max_chunks: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """The hits of each group that its context takes: numbered entries up to a count, until the first that would go
    beyond the characters. hits: group, doc_id, score, content. Only the first ``max_chunks`` of a group are moved."""
    w = Window.partitionBy(group).orderBy(*order)
    numbered = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_chunks)
    lines = numbered.withColumn("entry", tx.context_line(F.col("n"), F.col("doc_id").cast("string"), F.col("score"), F.col("content")))
    wn = Window.partitionBy(group).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used_chars", F.sum(F.length("entry")).over(wn)).where(F.col("used_chars") <= max_chars)


def context_text(rows: DataFrame, group: str) -> DataFrame:
    """Each group's context as one text."""
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "").alias("context"))
