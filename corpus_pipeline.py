"""From raw documents to packed token sequences: language ID, near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.language_id import held_out, learn, predict
from tessera.llm.packing import pack
from tessera.llm.repeats import PASSAGE, remove_repeats_of
from tessera.llm.simhash import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject, with the language it finds. Documents without a letter go."""
    models = learn(docs.where(~held_out()))
    kept = predict(docs.select(*COLUMNS), models).where(~F.col("rejected"))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five words, similarity 0.8): SimHash fingerprints
    find candidates by multi-index hashing, and exact similarities decide. Null and empty texts are one group; rows without
    an id stay unless a copy without an id, or a row with one, is near."""
    return drop_near_duplicates(docs.select(*COLUMNS), k=5, similarity=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words, or of 250 bytes, that also stand elsewhere (``repeats.PASSAGE``). A
    character goes if a byte of it does; a document of which nothing is left stays, empty. Null texts stay null, rows
    without an id and repeated rows are documents of their own."""
    cut = remove_repeats_of(docs.select(*COLUMNS), {"": PASSAGE})
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens. Null and empty texts are their end id alone; repeated
    rows are packed each."""
    pieces = pack(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]
#: Several stages are no SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
