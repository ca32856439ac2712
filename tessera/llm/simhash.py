"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint is cut into segments of about 21 bits. Two fingerprints of a small distance have a segment that
differs in at most one bit, so every fingerprint is entered in a table under each of its segments and looks up the
Hamming ball of radius 1 around each (a pair that differs in a bit is found from the side where it is set). Beyond
``MANY`` fingerprints, where so short segments would meet too many others by chance, segments have 32 bits and differ
in at most two: both sides enter and look up balls of radius 1. What a look-up finds is verified by its complete
distance. Distinct fingerprints are compared, never their copies; what is
found inside a bucket leaves it as a spanning forest, not as all pairs; buckets beyond a bound are dealt as a grid of
blocks to many tasks. Components come from the forests' edges.

Null and empty texts, and texts without words, have fingerprint zero and link like any other. Rows with a null id
get a component as well (null only if nothing reachable has an id); repeated rows and ties share theirs; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, discard, list_array, map_texts, stored, table
from tessera.llm.components import components
from tessera.llm.near_copies import similar_groups

SEED = 42
#: Widths of the segments of a 64-bit word. With three of them and radius 1, distances up to 5 are never missed.
SEGMENTS = (22, 21, 21)
#: With two of them and radius 2, likewise; and the number of fingerprints from which on these are taken.
WIDE, MANY = (32, 32), 1 << 26
#: Table rows of a bucket that one task holds; larger buckets are dealt as blocks.
BLOCK = 4096
#: Ids of documents that stay, up to which they are sent to all tasks (16 MB).
SENT_IDS = 1 << 20
#: One node of so many tells the sizes of buckets in which entries meet each other.
SHARE = 16
#: Pairs compared at a time.
PAIRS = 2_000_000
#: Odd multipliers that derive further hash words from a shingle's hash.
MIX = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, k: int) -> list[int]:
    """XXH64 of each k words, joined by a space; A-Z are lower-cased, ASCII white space parts words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:], strict=False)]


def fingerprint(df: DataFrame, text_col: str = "text", k: int = 4, words: int = 1) -> DataFrame:
    """Adds ``fp``, an array of 64-bit words: a bit is set if it is set in over half of all shingle hashes."""

    def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(counts), 64), bool)
        full = np.flatnonzero(counts)
        if len(full):
            begin = (np.cumsum(counts) - counts)[full]
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[full] = np.add.reduceat(bits, begin, axis=0, dtype=np.int32) * 2 > counts[full, None]
        return np.packbits(out, axis=1, bitorder="little").view("<i8").reshape(-1)

    def make():
        def run(texts: list[str]) -> dict[str, pa.Array]:
            lists = [shingle_hashes(t, k) for t in texts]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            h = np.fromiter((x for y in lists for x in y), np.uint64, int(counts.sum()))
            got = []
            for w in range(words):
                if w:
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
                    h ^= h >> np.uint64(29)
                got.append(majority(h, counts))
            return {"fp": list_array(np.stack(got, axis=1).reshape(-1), np.full(len(texts), words), pa.int64())}

        return run

    return map_texts(df, text_col, make, "fp array<long>")


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the links connect: fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _labels(at[: len(a)], at[len(a) :], len(nodes))
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _tree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b), none of a node with itself, make a spanning forest: fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    left, taken, label = np.arange(len(a)), [], np.arange(len(nodes))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        first = np.full(len(nodes), len(left))
        np.minimum.at(first, x, np.arange(len(left)))
        np.minimum.at(first, y, np.arange(len(left)))
        took = np.unique(first[first < len(left)])
        taken.append(left[took])
        label = _labels(x[took], y[took], len(nodes))[label]
        left = left[label[a[left]] != label[b[left]]]
    return np.concatenate(taken)


def links(prints: DataFrame, max_distance: int, words: int = 1, segments: tuple[int, ...] = SEGMENTS, block: int = BLOCK, radius: int = 1, by: range | None = None, scratch: Scratch | None = None, star: bool = False) -> DataFrame:
    """Edges (a, b) between nodes that connect all distinct fingerprints which a look-up finds at ``max_distance``
    or fewer differing bits. ``prints``: node long, fp array<long>, one row per fingerprint; ``radius`` is 0, 1 or 2.
    The first ``words`` words are compared; ``by`` are the words that are cut into segments, if not the same ones (a
    shorter fingerprint is entered under those that it has). ``scratch`` owns what is stored on the way.

    Of radius 0 nodes of one ``label``, a column that ``prints`` may have, count as connected: only those of different
    labels are compared, and of what is found one link between those that it connects leaves a bucket. A large bucket in
    which few rows lack the most frequent label is dealt by its rows, to which those few are added; others become a grid.
    ``star`` compares the rows of a bucket, or of a part of a large one, with its first row only.

    Complete if ``max_distance`` is below ``radius`` + 1 times the number of segments; else pairs beyond that are found
    as far as one of their segments is as close.
    """
    spark = prints.sparkSession
    shapes = [(w, sum(segments[:s]), width, w * len(segments) + s) for w in by or range(words) for s, width in enumerate(segments)]
    fps = [F.get("fp", F.lit(w)).alias(f"f{w}") for w in range(words)]

    def value(w: int, shift: int, width: int) -> F.Column:
        return F.shiftrightunsigned(F.get("fp", F.lit(w)), shift).bitwiseAND(F.lit((1 << width) - 1))

    def key(seg: int, v: F.Column) -> F.Column:
        return F.shiftleft(F.lit(seg).cast("long"), 32).bitwiseOR(v)

    entered = F.array(*[key(seg, value(w, shift, width)) for w, shift, width, seg in shapes])

    def flipped(w: int, shift: int, width: int, seg: int) -> F.Column:
        """Keys of the values that one bit else gives; of radius 1 one set bit less, as the other side does the rest."""
        v = value(w, shift, width)
        masks = F.array(*[F.lit(1 << j).cast("long") for j in range(width)])
        return F.transform(F.filter(masks, lambda m: v.bitwiseAND(m) != 0) if radius == 1 else masks, lambda m: key(seg, v.bitwiseXOR(m)))

    if radius == 0:  # a row is entry and look-up: it meets those before it in its bucket
        label = F.col("label" if "label" in prints.columns else "node").alias("label")
        both = rows = prints.select("node", F.explode(entered).alias("key"), F.lit(0).cast("byte").alias("kind"), label, *fps).where("key is not null")
        # how buckets are dealt doesn't change what is found, so a share of the nodes tells which are large
        counted, share = rows.where(F.pmod("node", F.lit(SHARE)) == 0), SHARE
    else:
        balls = F.concat(entered, *[flipped(*x) for x in shapes])
        rows = prints.select("node", F.explode(entered if radius == 1 else balls).alias("key"), F.lit(0).cast("byte").alias("kind"), *fps)
        probes = prints.select("node", F.explode(balls).alias("key"), F.lit(1).cast("byte").alias("kind"), *fps)
        both, counted, share = rows.unionByName(probes), rows, 1
    if radius == 0:
        of_label = counted.groupBy("key", "label").agg((F.count("*") * share).alias("m"))
        counts = of_label.groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("label", "m").alias("common"))
        common = F.when(F.col("n") - F.col("most") <= block, F.col("common")).alias("common")
    else:
        counts, common = counted.groupBy("key").agg((F.count("*") * share).alias("n")), F.lit(None).cast("long").alias("common")
    sizes = (scratch.stored if scratch else stored)(counts.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"), common), "buckets")
    if (hot := sizes.count()) and star:
        # parts differ from segment to segment, so that their stars meet
        dealt = both.join(F.broadcast(sizes) if hot <= 100_000 else sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        both = dealt.withColumn("cell", F.pmod(F.xxhash64("node", "key"), F.col("blocks"))).drop("blocks", "common")
    elif hot:
        dealt = both.join(F.broadcast(sizes) if hot <= 100_000 else sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own, every = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
        whole = F.col("common").isNotNull() if radius == 0 else F.lit(False)  # the rows of the common label need not meet
        if radius == 0:
            every = F.when(whole & (F.col("label") == F.col("common")), F.array(own)).otherwise(every)
        dealt = dealt.withColumn("other", F.explode(every))
        row, column = F.when(F.col("kind") == 0, own).otherwise(F.col("other")), F.when(F.col("kind") == 0, F.col("other")).otherwise(own)
        if radius == 0:
            row, column = F.least(own, "other"), F.greatest(own, "other")
        both = dealt.withColumn("cell", F.when(whole, F.col("other")).otherwise(row * F.col("blocks") + column)).drop("blocks", "other", "common")
    else:
        both = both.withColumn("cell", F.lit(0))
    names = [f"f{w}" for w in range(words)]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            k, cell, kind, node, label, *f = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ["key", "cell", "kind", "node", "label" if radius == 0 else "node", *names])
            f = np.stack(f, axis=1).view(np.uint64)
            head = np.append(True, (k[1:] != k[:-1]) | (cell[1:] != cell[:-1]))
            old = 0
            if kept is not None and len(k) and (k[0], cell[0]) == kept[0]:
                old = len(kept[1])
                k, cell, kind = (np.concatenate([np.full(old, x, y.dtype), y]) for x, y in ((k[0], k), (cell[0], cell), (0, kind)))
                node, f, label = np.concatenate([kept[1], node]), np.concatenate([kept[2], f]), np.concatenate([kept[3], label])
                head = np.concatenate([[True], np.zeros(old, bool), head[1:]]) if old else head
            if not len(k):
                continue
            group = np.cumsum(head) - 1
            begin = np.flatnonzero(head)
            in_table = np.bincount(group[kind == 0], minlength=len(begin))
            last = begin[-1]
            mine = slice(last, last + (1 if star else in_table[-1]))
            kept = ((k[-1], cell[-1]), node[mine].copy(), f[mine].copy(), label[mine].copy())
            if radius == 0:  # those before it that have another label
                begins = head | np.append(True, label[1:] != label[:-1])
                met = np.flatnonzero(begins)[np.cumsum(begins) - 1] - begin[group]
                met = np.minimum(met, 1) if star else met
            else:
                met = np.where(kind == 1, in_table[group], 0)
            met[:old] = 0
            p = np.flatnonzero(met)
            per = met[p]
            part = (np.cumsum(per) - 1) // (PAIRS // words)
            for q in np.split(np.arange(len(p)), np.flatnonzero(np.diff(part)) + 1):
                if not len(q):
                    continue
                a = np.repeat(p[q], per[q])
                start, ends = begin[group[p[q]]], np.cumsum(per[q])
                b = np.repeat(start - (ends - per[q]), per[q]) + np.arange(len(a))
                other = node[a] != node[b]
                a, b = a[other], b[other]
                near = np.bitwise_count(f[a] ^ f[b]).sum(axis=1) <= max_distance
                if near.any():
                    a, b = a[near], b[near]
                    if radius == 0:
                        tree = _tree(label[a], label[b])
                        x, y = node[a[tree]], node[b[tree]]
                    else:
                        x, y = _forest(node[a], node[b])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    order = ["key", "cell", "label"] if radius == 0 else ["key", "cell", "kind"]
    return both.repartition("key", "cell").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, max_distance: int = 4, words: int = 1) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``, the smallest id that links reach, itself included, for each row.
    Fingerprints of ``words`` words of 64 bits link at ``max_distance`` or fewer differing bits."""
    scratch = Scratch()
    prints = stored(fingerprint(df.select(id_col, text_col), text_col, k, words).select(id_col, "fp"), "prints")
    node = F.get("fp", F.lit(0)) if words == 1 else F.xxhash64("fp")
    distinct = scratch.stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")).withColumn("node", node), "distinct")
    segments, radius = (WIDE, 2) if distinct.count() > MANY else (SEGMENTS, 1)
    found = scratch.own(components(links(distinct.select("node", "fp"), max_distance, words, segments, radius=radius)))
    rooted = scratch.stored(distinct.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = scratch.stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_print = scratch.result(rooted.join(least, "root").select("fp", "component_id"), "of-print")
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, whole and with all columns. Links are exact
    similarities of shingle sets (``near_copies``) among what multi-index hashing finds, as a fingerprint's distance only
    estimates them. Of rows with the
    same id and text one stays; rows without an id stay unless they have such a copy or a row with an id is near."""
    groups = similar_groups(df, id_col, text_col, k, similarity)
    stay = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("stays"))
    counted = stored(stay.groupBy("stays").agg(F.count("*").alias("n")), "stays")
    discard(groups)
    # up to a bound the ids are sent to the tasks, so that texts stay where they are
    ids = F.broadcast(counted) if counted.count() <= SENT_IDS else counted.hint("merge")
    rows = lambda which: df.join(ids.where(which).select("stays"), df[id_col].eqNullSafe(ids["stays"]), "left_semi")
    if counted.where("n > 1").isEmpty():
        return rows("n = 1")
    return rows("n = 1").unionByName(rows("n > 1").dropDuplicates([id_col, text_col]))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of 4-word shingles and component at 4 or fewer differing bits, of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = near_duplicates(docs, k=4, max_distance=4, words=1)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")
