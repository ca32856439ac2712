"""Index pipeline: documents to store rows, and the ports it calls."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.operators import chunking
from tessera.session import written

#: A model: texts to vectors.
Embed = Callable[[list[str]], np.ndarray]
INPUT_TYPES = {"table": "TABLE", "image-caption": "IMAGE_CAPTION", "ocr": "OCR"}


def hash_embedding(dimension: int = 64) -> Embed:
    """A deterministic stand-in: each word adds one to a hashed coordinate; vectors have norm 1."""

    @functools.lru_cache(100_000)
    def place(word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little") % dimension

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, t in zip(out, texts, strict=True):
            words = t.lower().split()
            row += np.bincount(np.fromiter(map(place, words), np.int64, len(words)), minlength=dimension)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)

    return embed


def embedded(df: DataFrame, make: Callable[[], Embed], text: str = "content", out: str = "embedding", hashed: str | None = None) -> DataFrame:
    """Adds vectors. Each distinct text is embedded once; a model is made once per task; failed tasks run again.

    ``df`` is read twice, for its distinct texts and for its rows, so it should be a table. ``hashed`` names a column
    that already has the texts' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                v = np.asarray(model([t or "" for t in part.column(1).to_pylist()]), np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["_hash", out])

    keyed = df.withColumn("_hash", F.col(hashed) if hashed else tx.content_hash(F.coalesce(F.col(text), F.lit(""))))
    vectors = keyed.select("_hash", text).dropDuplicates(["_hash"]).mapInArrow(run, f"_hash string, {out} array<float>")
    return keyed.join(vectors, "_hash").drop("_hash")


def input_type(chunk_type: Column) -> Column:
    """What kind of input a chunk is to a model."""
    known = F.create_map(*[F.lit(x) for pair in INPUT_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, chunk_type), F.lit("TEXT"))


@dataclass(frozen=True)
class Profile:
    """A named model: what it is asked by, its dimension and the inputs it takes."""

    name: str
    provider: str
    model: str
    dimension: int
    inputs: tuple[str, ...] = ("TEXT",)


def resolve(profiles: Iterable[Profile], name: str | None = None, provider: str | None = None, model: str | None = None, kind: str = "TEXT") -> Profile:
    """The profile of a name, or of a provider and model, never of both; it has to take the kind of input."""
    if (name is None) == (provider is None and model is None):
        raise ValueError("give a profile, or a provider and a model")
    found = [p for p in profiles if (p.name == name if name is not None else (provider in (None, p.provider) and model in (None, p.model)))]
    if not found or kind not in found[0].inputs:
        raise ValueError(f"no profile takes {kind}")
    return found[0]


def resolved(requests: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """``resolve`` for a table of requests: ``key`` and ``profile``, null where no profile answers. requests: key, name,
    provider, model, kind (null: TEXT); profiles: position, profile, provider, model, inputs. The first profile by
    position that is asked for has to take the kind of input. Each way of asking is an equi-join of its own."""
    asked = requests.select(key, F.col("name").alias("_name"), F.col("provider").alias("_provider"), F.col("model").alias("_model"), F.coalesce("kind", F.lit("TEXT")).alias("_kind"))
    ways = [
        ("_name is not null and _provider is null and _model is null", {"_name": "profile"}),
        ("_name is null and _provider is not null and _model is not null", {"_provider": "provider", "_model": "model"}),
        ("_name is null and _provider is not null and _model is null", {"_provider": "provider"}),
        ("_name is null and _provider is null and _model is not null", {"_model": "model"}),
    ]
    found = None
    for which, on in ways:
        firsts = profiles.groupBy(*on.values()).agg(F.min_by(F.struct("profile", "inputs"), "position").alias("_p")).select(*[F.col(c).alias(a) for a, c in on.items()], "_p")
        part = asked.where(which).join(firsts, list(on)).where(F.array_contains("_p.inputs", F.col("_kind"))).select(key, F.col("_p.profile").alias("profile"))
        found = part if found is None else found.unionByName(part)
    return requests.select(key).join(found, key, "left")


def cleaned(df: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], text: str = "text", most_chars: int | None = None) -> DataFrame:
    """Texts as a cleaner returns them, and whether it did. Where the cleaner fails or returns nothing the text stays.
    ``most_chars`` is for a model that takes only so many characters: it gets a longer text in parts of that size, and
    its answers are put together; if one part isn't answered the whole text stays."""
    kept = [f for f in df.schema.fields if f.name not in (text, "cleaned")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = make()

        def answer(t: str) -> str | None:
            step = most_chars or len(t)
            try:
                parts = [clean([t[i : i + step]])[0] for i in range(0, len(t), step)]
            except Exception:  # a cleaner is someone else's service; the text is what matters
                return None
            return "".join(parts) if all(p and p.strip() for p in parts) else None

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            done = [answer(t) if t else None for t in texts]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n or t for n, t in zip(done, texts, strict=True)], pa.string()), pa.array([n is not None for n in done])], names=[*names, text, "cleaned"])

    schema = T.StructType([*kept, T.StructField(text, T.StringType()), T.StructField("cleaned", T.BooleanType())])
    return df.mapInArrow(run, schema)


def keywords(df: DataFrame, doc: str = "doc_id", text: str = "text", n: int = 10, most_chars: int | None = None) -> DataFrame:
    """The n most frequent terms of each text, a deterministic stand-in for a model. A document of one row is counted where
    its text is, and none of its terms is moved; of documents of several rows counts are aggregated per term, so that rows
    of any number spread over tasks. ``most_chars`` is for a model that takes only a text's first characters."""
    read = F.col(text) if most_chars is None else F.substring(text, 1, most_chars)
    tokens = F.filter(F.split(F.lower(read), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2)
    said = df.select(doc, tokens.alias("terms"))
    kind = df.schema[doc].dataType
    schema = T.StructType([T.StructField(doc, kind), T.StructField("keywords", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), most_frequent(part.column(1), n)], names=[doc, "keywords"])

    def counted(rows: DataFrame) -> DataFrame:
        each = rows.select(doc, F.explode("terms").alias("term")).groupBy(doc, "term").agg(F.count("*").alias("n"))
        top = each.groupBy(doc).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "term"))), 1, n).alias("t"))
        return top.select(doc, F.transform("t", lambda x: x["term"]).alias("keywords"))

    # ids alone are moved to find those of several rows
    several = df.groupBy(doc).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(doc).alias("_several"))
    if several.isEmpty():
        return said.mapInArrow(run, schema).where(F.size("keywords") > 0)
    several = written(several, "several")
    same = said[doc].eqNullSafe(several["_several"])
    once = said.join(several, same, "left_anti").mapInArrow(run, schema).where(F.size("keywords") > 0)
    return once.unionByName(counted(said.join(several, same, "left_semi")))


def most_frequent(terms: pa.ListArray, n: int) -> pa.ListArray:
    """Each list's n most frequent terms, the most frequent first, ties by the terms' bytes; a null list has none."""
    sizes = np.asarray(terms.value_lengths().fill_null(0))
    coded = terms.flatten().dictionary_encode()
    by_bytes = pc.array_sort_indices(coded.dictionary)
    words = coded.dictionary.take(by_bytes)
    place = np.empty(len(words), np.int64)
    place[np.asarray(by_bytes)] = np.arange(len(words))
    key = np.repeat(np.arange(len(sizes)), sizes) * max(len(words), 1) + place[np.asarray(coded.indices)]
    key, counts = np.unique(key, return_counts=True)
    row, term = np.divmod(key, max(len(words), 1))
    order = np.lexsort((term, -counts, row))
    row, term = row[order], term[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < n
    lengths = np.bincount(row[kept], minlength=len(sizes))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(term[kept])))


def index_documents(docs: DataFrame, make: Callable[[], Embed], strategy: str = "recursive", sizes: chunking.Sizes = chunking.Sizes(), object_type: str = "document") -> DataFrame:
    """Store rows of documents (doc_id, text): cleaned, cut, linked, embedded. Chunks are written once, as both the
    distinct texts and the rows are taken from them."""
    clean = docs.select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    chunks = written(chunking.chunk(clean, strategy, sizes=sizes), "chunks")
    rows = embedded(chunks, make, hashed="content_hash")
    return rows.select(
        F.lit(object_type).alias("object_type"), F.col("doc_id").cast("string").alias("object_id"), F.col("chunk_order").alias("chunk_index"), "chunk_id",
        F.col("doc_id").cast("string").alias("document_id"), "prev_chunk_id", "next_chunk_id", F.col("content").alias("text"), "content_hash", "token_count", "char_count", "strategy", "embedding",
    )


@dataclass(frozen=True)
class SourceExecutor:
    """A way to run index jobs of the requests it supports. ``execute`` gives store rows of a request's documents."""

    supports: Callable[[dict], bool]
    execute: Callable[[dict], DataFrame]


def run_job(request: dict, executors: Sequence[SourceExecutor]) -> DataFrame:
    """What the first executor that supports the request gives."""
    for executor in executors:
        if executor.supports(request):
            return executor.execute(request)
    raise ValueError(f"no executor supports the source {request.get('source_type')!r}")
