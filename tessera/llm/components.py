"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _stars(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One step: neighbours of u (only the smaller ones in a small step) move to the smallest of them and u."""
    if large:
        arms = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        arms = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = arms.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:  # written first: the join then has plain exchanges on both sides, and a hub's arms can be split
        least = scratch.stored(least, "least")
    moved = arms.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = moved.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``, as a stored table, for every node of the edges (a, b longs): the root is the smallest node it can reach.

    Rows with a null end or equal ends count for nothing. Each round is written to the shared folder, which cuts the
    lineage; the driver sees a row count and a checksum per round. Minima are combined before they are moved, and a
    large star's arms are joined by a plain equi-join, which adaptive execution splits where it is skewed.
    """
    scratch = Scratch()
    now = scratch.stored(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen, before = state, scratch
        scratch = Scratch()
        # a small star reads its edges twice, so they are written
        now = scratch.stored(_stars(before.stored(_stars(now, True, before), "large"), False, before), "edges")
        before.discard(*before.tables)
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    return scratch.result(nodes, "components")
