"""The corpus pipeline: each stage's effect on documents made for it."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts, start=0):
    return [(start + i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars").withColumn("n_chars", F.length("text").cast("long"))
    bad = spark.createDataFrame(rows(None, "", "1234 !!", "жлупщ цчшщ " * 60, start=90_000), SCHEMA).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(bad), SF).collect()}
    assert not kept & set(range(90_000, 90_004))
    assert len(kept) >= docs.count() - 5


def test_near_dedup_stage(spark):
    base = prose(1, 400)
    near = base.replace(base.split()[50], "changed", 1)
    df = spark.createDataFrame(rows(prose(2, 300), base, near, base, prose(3, 300), "", ""), SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [0, 1, 4, 5]


def test_stages_with_null_and_repeated_ids(spark):
    """Rows without an id, and rows of one id, go through every stage; of exact copies of a row near_dedup keeps one."""
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) > 500").orderBy("doc_id").limit(4).collect()
    a, b, c, d = (t.text for t in texts)
    made = [(None, a), (None, a), (None, b), (7, c), (7, c), (7, d), (8, c)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], SCHEMA)
    learned = spark.read.parquet(f"{SF}/documents.parquet")
    both = df.unionByName(learned.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")))
    kept = corpus_pipeline.language(spark, both, SF)
    assert kept.where("doc_id is null").count() == 3 and kept.where(F.col("text").isin(c, d) & F.col("doc_id").isin(7, 8)).count() >= 4
    stay = corpus_pipeline.near_dedup(spark, df, SF).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in stay)) == sorted([(False, 0, a), (False, 0, b), (True, 7, c), (True, 7, d)])
    assert corpus_pipeline.suffix_dedup(spark, df, SF).count() == len(made)
    pieces = corpus_pipeline.packing(spark, df, SF)
    assert pieces.where("doc_id is null").agg(F.sum("length")).first()[0] > 0 and pieces.where("start = 0").count() == len(made)


def test_suffix_dedup_stage(spark):
    passage = "é" + prose(4, 60) + "ü"
    df = spark.createDataFrame(rows(prose(5, 80) + passage + prose(6, 80), passage + prose(7, 90), prose(8, 90), None), SCHEMA)
    out = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, df, SF).collect()}
    assert all(passage not in (out[i].text or "") and len(out[i].text) < len(t) for i, t in ((0, df.collect()[0].text), (1, df.collect()[1].text)))
    assert out[2].text == prose(8, 90) and out[3].text is None and out[0].n_chars == len(out[0].text)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "suffix_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
