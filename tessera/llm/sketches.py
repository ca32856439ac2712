"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the text's, sketches
of parts merge into the sketch of the whole, and containment can be estimated between very unequal documents. The
smallest hash is kept in any case, so no text with words has an empty sketch.

Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than a shingle has one
shingle, all of them. Null and empty texts, and texts without words, have the empty sketch, which is like itself (1)
and nothing else (0). Repeated rows and ties are fingerprinted each on its own; among rows of one id the order of
texts decides which is next. Rows without an id come first. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, table, text_slices

#: Words of a shingle, and the fraction of the hash range that is kept.
SHINGLE, FRACTION = 5, 1 / 4
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """XXH64 of words, remembered up to a bound of words and of their bytes."""

    def __init__(self, limit: int = 600_000, most_bytes: int = 12_000_000):
        self.known: dict[bytes, int] = {}
        self.limit, self.most_bytes, self.held = limit, most_bytes, 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit or self.held > self.most_bytes:
            self.known.clear()
            self.held = 0
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
            self.held += len(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """The words met before, kept while the worker lives."""
    return WordHashes()


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash of each k consecutive words from the words' hashes."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        h = (h ^ words[i : i + n]) * _MIX
        h ^= h >> np.uint64(32)
    return h


def keep(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch: sorted distinct hashes below the fraction, and the smallest of all."""
    if not len(hashes):
        return hashes
    kept = hashes[hashes < np.uint64(int(fraction * 2.0**64))]
    return np.unique(kept) if len(kept) else hashes.min(keepdims=True)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of what both cover."""
    return keep(np.concatenate([a, b]), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of both texts' shingles that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def text_form(sketch: np.ndarray) -> str:
    """The sketch as lowercase hex, 16 digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    """The sketch of its text form."""
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def sketch(text: str, k: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    """A text's sketch."""
    return keep(shingle_hashes(word_hashes()(text.encode("utf-8", "surrogatepass").lower().split()), k), fraction)


def add_fingerprints(df: DataFrame, text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Adds ``fingerprint`` to each row."""
    def make():
        return lambda texts: {"fingerprint": pa.array([text_form(sketch(t, k, fraction)) for t in texts], pa.string())}

    return map_texts(df, text_col, make, "fingerprint string")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows in ascending id order in ranges, ``part`` naming the range, each range ended by a copy of the row that
    follows it (``tail``), the last one's by the first of all. One shuffle, and a row more for each range.

    Ranges come from quantiles of the ids; the driver gets one id for each.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(rows.where("id is not null").select("id").stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    part = _bucket(edges)
    rows = rows.withColumn("part", part.cast("int"))
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("m")).orderBy("part").collect()  # a row per range
    used, firsts = [r.part for r in least], [r.m.id for r in least]
    if not used:
        return rows.withColumns({"tail": F.lit(False)})
    to = _before(len(edges) + 1, used, firsts)  # a row that begins its range is sent to the range before as well
    copies = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")), F.struct(to.cast("int").alias("part"), F.lit(True).alias("tail")))
    return rows.select("id", "text", F.explode(F.filter(copies, lambda c: c["part"].isNotNull())).alias("c")).select("c.part", "c.tail", "id", "text")


def _bucket(edges: list[float]) -> F.Column:
    """Number of edges below the id, by halving: a tree of comparisons instead of one for each edge."""

    def tree(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("id") <= F.lit(int(edges[mid])), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(F.col("id").isNull(), F.lit(0)).otherwise(tree(0, len(edges)))


def _before(parts: int, used: list[int], firsts: list[int | None]) -> F.Column:
    """For rows that begin their range the range before, else null; both are looked up by the row's range."""
    first, before = [None] * parts, [None] * parts
    for p, f, b in zip(used, firsts, used[-1:] + used[:-1], strict=True):
        first[p], before[p] = f, b
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("part"))
    return F.when(F.col("id").eqNullSafe(of(first, "long")), of(before, "int"))


def edited(text: str, following: str) -> str:
    """The text, its last quarter of code points replaced by as many first ones of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row, in ascending id order: id, n_chars, the edited text's digest, both fingerprints, and their
    likenesses to the edited text and to the next row's text."""
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, text, sketch of the row before

        def row(own: tuple, text: str, sketch_: np.ndarray) -> tuple:
            new = edited(own[2], text)
            its = sketch(new, k, fraction)
            return (own[1], len(own[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_form(own[3]), text_form(its), likeness(own[3], its), likeness(own[3], sketch_))

        for batch in batches:
            parts, tails, ids, texts = (c.to_pylist() for c in batch.columns)
            for i, j in text_slices(texts):
                out = []
                for n in range(i, j):
                    if tails[n] and (held is None or held[0] != parts[n]):
                        continue  # the tail's first row of several of one id has been used
                    s = sketch(texts[n], k, fraction)
                    if held is not None and held[0] == parts[n]:
                        out.append(row(held, texts[n], s))
                    held = None if tails[n] else (parts[n], ids[n], texts[n], s)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(df, id_col, text_col, parts).withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", F.asc_nulls_first("id"), "mark").select("part", "tail", "id", "text")
    return ordered.mapInArrow(run, schema)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")
