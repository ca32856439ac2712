"""Shards against their law, in plain Python."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

SF = "/root/testdata/sf0.01"


def held(rows, n=16, spread=0.04):
    """Sizes nearly equal, slots gapless, equal texts together unless they are more than a shard's share."""
    load, slots, of = Counter(), defaultdict(list), defaultdict(Counter)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[r.text][r.shard] += r.size
    share = sum(load.values()) / n
    assert set(load) <= set(range(n)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) <= share * (1 + spread) + max(r.size for r in rows)
    assert min(load[s] for s in range(n)) >= share * (1 - spread) - max(r.size for r in rows)
    for shards in of.values():
        assert len(shards) == 1 or sum(shards.values()) > share * 0.5
    return load


def test_query_holds_its_law(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = sharding.op13_sharding(spark, SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and dict(out.dtypes)["text_crc32"] == "bigint"
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert len(load) == 16 and max(load.values()) < 1.04 * min(load.values())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    text_of = {k: v or "" for k, v in docs.items()}
    shards = defaultdict(set)
    for r in rows:
        shards[text_of[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_hot_groups_are_subdivided_and_others_stay_whole(spark):
    rows = [(i, "the same text " * 5) for i in range(1500)] + [(9000 + i, f"text {i} " * (1 + i % 7)) for i in range(1500)]
    rows += [(20_000 + i, "copies that fit") for i in range(200)] + [(30_000, "long " * 1000), (30_001, None), (30_002, ""), (None, "no id"), (7, "the same text " * 5), (7, "the same text " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit("clash"), "_extra": F.lit(1)})
    got = sharding.shards(df.repartition(7), ranges=256, most_rows=50).collect()
    assert len(got) == len(rows) and "_extra" in got[0] and Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    held(got)
    of = defaultdict(set)
    for r in got:
        of[r.text].add(r.shard)
    assert len(of["the same text " * 5]) > 4 and all(len(s) == 1 for t, s in of.items() if t != "the same text " * 5)


def test_a_group_of_one_row_many_times(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("again").alias("text"))
    got = sharding.shards(df.repartition(4), 8, ranges=64, most_rows=100)
    counts = {r.shard: (r.n, r.low, r.high) for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()}
    assert sum(n for n, _, _ in counts.values()) == 4000 and all((low, high) == (0, n - 1) for n, low, high in counts.values())
    assert len(counts) == 8 and max(n for n, _, _ in counts.values()) < 700


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    df = spark.createDataFrame([(i, "x" * 50 * (3 - i)) for i in range(n)], "doc_id long, text string")
    got = sharding.shards(df).collect()
    assert len(got) == n and len({r.shard for r in got}) == n and all(r.slot == 0 for r in got)


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    held(back.collect(), 4)
