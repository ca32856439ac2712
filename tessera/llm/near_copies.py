"""Groups of texts whose shingle sets have at least a given Jaccard similarity: SimHash fingerprints find candidates by
multi-index hashing (``simhash.links``), and every link is the exact similarity of two texts' sets.

Texts of the same set are one node. A node's fingerprint has ``WORDS`` words of 64 bits, each cut into four segments of 16
bits, and nodes meet where a segment is equal. At similarity 0.8 a bit differs with probability 0.1515 at most (sets have a
cosine of 0.889), so that two nodes share one of 128 segments with probability 0.99993; sets of fewer than ``FEW`` shingles,
whose bits differ more often (0.1875 for four shingles in five), have twice as many. Those that meet are candidates if
their first ``CHECKED`` words differ in ``DISTANCE`` bits or fewer: 39 are expected at similarity 0.8, with a spread of 6
(48 and 6 for four shingles in five), and 128 between texts that share nothing.

At first a bucket's nodes meet its first node only, under a few segments. What that connects gets one label, and nodes of
one label do not meet in the passes over all segments; of what meets there one pair leaves a bucket for each two labels that
it connects. So a large group of near copies leaves some pairs for each node, not one for each of 128 buckets. These pairs
are verified one by one, which joins most groups. Only groups of three and more candidates that this leaves in several
components are met again with their texts: there all candidates of different components are compared, in blocks if there
are many, and links leave as verified edges.

Null and empty texts, and texts without words, have no shingles: they are one node that meets no other. Texts of fewer
words than a shingle have their whole sequence as the only one. Repeated rows and texts of the same set get the same
component, ties cannot arise (a component is its smallest id), rows without an id get the smallest id that is near them
(null only if none has one), and an empty table gives an empty table. Other columns of the table aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, expand, list_array, map_texts
from tessera.llm.components import components

WORDS, SEGMENTS = 32, (16, 16, 16, 16)
#: Sets of fewer shingles have twice as many words.
FEW = 6
#: Candidates differ in so many bits of so many words at most.
DISTANCE, CHECKED = 76, 4
#: Words whose segments are met at a time, so that only their entries are moved at once; and before that by stars.
PASS, FIRST = 8, 2
#: Passes after each of which nodes get the labels of what is connected by then. More save links, but take as long as they save.
NAMED = 1
#: A byte's bits, one in each byte of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")
#: Nodes of a bucket that one task holds with their texts; larger buckets are dealt as a grid of blocks.
BLOCK = 256
#: Odd multiplier that derives further hash words from a shingle's hash.
MIX = np.uint64(0x9E3779B97F4A7C15)


def majorities(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of sets of hashes, one row of ``words`` words each: a bit is set if it is set in over half of a set's
    hashes. Of one half the set's first hash decides, so that small sets aren't drawn to zero. No set is empty."""
    begin = np.cumsum(counts) - counts
    parts = -(-counts // 255)  # so many hashes' bits can be summed in bytes
    first = np.cumsum(parts) - parts
    cuts = np.repeat(begin - 255 * first, parts) + 255 * np.arange(int(parts.sum()))
    out = np.empty((len(counts), words), np.int64)
    for w in range(words):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * MIX
        hashes ^= hashes >> np.uint64(29)
        lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.stack([np.add.reduceat(SPREAD[lanes[:, i]], cuts) for i in range(8)], axis=1).view(np.uint8)
        total = np.add.reduceat(sums, first, axis=0, dtype=np.int32)
        total = 2 * total + np.unpackbits(lanes[begin], axis=1, bitorder="little")
        out[:, w] = np.packbits(total > counts[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def sketches(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """Adds ``node``, a hash of the text's shingle set, ``fp``, its fingerprint (a text without words has none), and
    ``packed``, the text compressed, as it is moved."""

    def make():
        pack = zstandard.ZstdCompressor(level=3).compress

        def run(texts: list[str]) -> dict[str, pa.Array]:
            sets = [shingle_set(t, k) for t in texts]
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            counts = np.fromiter(map(len, sets), np.int64, len(sets))
            sizes = np.where(counts == 0, 0, np.where(counts < FEW, 2 * WORDS, WORDS))
            prints = np.empty(int(sizes.sum()), np.int64)
            ends = np.cumsum(sizes)
            for size in (WORDS, 2 * WORDS):
                if len(which := np.flatnonzero(sizes == size)):
                    made = majorities(np.concatenate([sets[i] for i in which]), counts[which], size)
                    prints[expand(ends[which] - size, sizes[which])] = made.reshape(-1)
            packed = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
            return {"node": pa.array(nodes), "fp": list_array(prints, sizes, pa.int64()), "packed": packed}

        return run

    return map_texts(df, text_col, make, "node long, fp array<long>, packed binary")


def unpacked(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    from tessera.llm.simhash import shingle_hashes

    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """If the sets' Jaccard similarity is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; ``texts``: node, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, left = [], None, None
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, b = a.as_py(), b.as_py()
                if a != last:
                    last, left = a, shingle_set(unpacked(x.as_py()), k)
                if similar(left, shingle_set(unpacked(y.as_py()), k), least):
                    out.append((a, b))
            yield _edges(out)

    # merges at every size: neither pairs nor texts have a bound, so none of them is broadcast
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("x")).hint("merge"), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("y")).hint("merge"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def across(rows: DataFrame, k: int, least: float) -> DataFrame:
    """Edges that join the components which candidates of one group and cell are in, as far as they are similar. ``rows``:
    key, cell, side (0, 1, or 2 where a block meets itself), node, label, packed, checked (words of the fingerprint)."""

    def linked(group: list[tuple]) -> list[tuple[int, int]]:
        if not group:
            return []
        root = {g[2]: g[2] for g in group}
        side, label = (np.array([g[i] for g in group]) for i in (0, 2))
        f = np.array([g[4] for g in group], np.int64).view(np.uint64)
        bits = sum(np.bitwise_count(f[:, None, w] ^ f[None, :, w]).astype(np.int16) for w in range(f.shape[1]))
        meet = (bits <= DISTANCE) & (label[:, None] != label[None, :]) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))

        @cache
        def words(i: int) -> np.ndarray:
            return shingle_set(unpacked(group[i][3]), k)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.tril(meet, -1))), strict=True):
            x, y = find(group[i][2]), find(group[j][2])
            if x != y and similar(words(i), words(j), least):
                root[x] = y
                out.append((group[i][1], group[j][1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            out = []
            for key, cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, cell) != at:
                    out += linked(group)
                    at, group = (key, cell), []
                group.append(tuple(row))
            yield _edges(out)
        yield _edges(linked(group))

    return rows.select("key", "cell", "side", "node", "label", "packed", "checked").repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a long, b long")


def joined(near: DataFrame | None, edges: list[DataFrame]) -> DataFrame:
    """Components of the edges and of what is connected already."""
    known = [near.select(F.col("root").alias("a"), F.col("node").alias("b"))] if near else []
    return components(reduce(DataFrame.union, edges + known))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``id_col`` and ``component_id``, the smallest id that links reach, itself included, for each row."""
    from tessera.llm.simhash import links

    own = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scratch = Scratch()
    prints = scratch.stored(sketches(own, "text", k).drop("text"), "sketches")
    ids = scratch.stored(prints.select("id", "node"), "ids")
    distinct = scratch.stored(prints.groupBy("node").agg(F.first("fp").alias("fp")).where(F.size("fp") > 0), "nodes")
    # stars first: what is connected is not compared again, so links and comparisons of large groups grow with their size
    named, near, passes, new = distinct.withColumn("label", F.col("node")), None, [], []
    for words in [range(FIRST)] + [range(w, w + PASS) for w in range(0, WORDS, PASS)] + [range(WORDS, 2 * WORDS)]:
        some = named.where(F.size("fp") > WORDS) if words.start == WORDS else named
        new.append(scratch.stored(links(some, DISTANCE, CHECKED, SEGMENTS, radius=0, by=words, scratch=scratch, star=not passes).distinct(), "met"))
        passes.append(new[-1])
        if len(passes) <= NAMED:
            near, new = scratch.own(joined(near, new)), []
            # a merge at every size: how many nodes met others has no bound, so none of it is broadcast
            named = scratch.stored(distinct.join(near.hint("merge"), "node", "left").select("node", "fp", F.coalesce("root", "node").alias("label")), "named")
    scratch.discard(distinct)
    near = scratch.own(joined(near, new))
    pairs = scratch.stored(reduce(DataFrame.union, passes).distinct(), "pairs")
    scratch.discard(*passes)
    own_text = prints.join(near.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("packed").alias("packed"), F.first(F.slice("fp", 1, CHECKED)).alias("checked"))
    texts = scratch.stored(own_text, "texts")
    scratch.discard(prints)
    edges = scratch.stored(verified(pairs, texts, k, similarity), "verified")
    scratch.discard(pairs)
    roots = scratch.own(components(edges))
    labelled = scratch.stored(near.select("node", F.col("root").alias("key")).join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")), "labelled")
    open_ = scratch.stored(labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low < high").select("key", "n"), "open")
    left = labelled.join(open_, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    left = left.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    cell = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    more = across(left.select("key", cell.alias("cell"), side.alias("side"), "node", "label").join(texts, "node"), k, similarity)
    more = scratch.stored(more, "across")
    scratch.discard(texts, near, labelled, open_)
    found = scratch.own(components(edges.unionByName(more))) if not more.isEmpty() else roots
    least = ids.groupBy("node").agg(F.min("id").alias("least"))
    rooted = scratch.stored(least.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    smallest = scratch.stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_node = rooted.join(smallest, "root").select("node", "component_id")
    return scratch.result(ids.join(of_node, "node").select(F.col("id").alias(id_col), "component_id"), "near-copies")
