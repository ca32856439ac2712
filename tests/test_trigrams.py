"""Contains-search by grams against trying every text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters, trigrams


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcA é%_") for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(1, "AbcAbc"), (1, "abcabc"), (None, "xabcx"), (7, None), (8, ""), (9, "ab"), (10, "rare needle here")]
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


def test_results_are_those_of_a_scan(docs):
    index = trigrams.build(docs, blocks=8)
    for pattern in ("abc", "aBCa", "a_ca", "abc%ca", "é%a", "ab", "", "%", "needle", "absent words", "ab\\_c", "ca\\%", "b é"):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in trigrams.contains(index, pattern).collect()))
        want = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.where(F.lower("text").like(f"%{pattern.lower()}%")).collect()))
        assert got == want, pattern
    same = docs.where(filters.keyword("aBCa", F.col("text"))).count()
    assert trigrams.contains(index, "aBCa").count() == same > 0
    assert trigrams.contains(trigrams.build(docs.limit(0)), "abc").count() == 0


def test_only_blocks_with_candidates_are_read(docs):
    index = trigrams.build(docs, blocks=8)
    assert trigrams.candidates(index, "needle").count() == 1 and trigrams.grams_of("a%bcd_efgh\\%ijk") == ["bcd", "efg", "fgh", "ijk"]
    found = trigrams.contains(index, "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan.split("PartitionFilters: [")[1].split("]")[0] and [r.doc_id for r in found.collect()] == [10]


def test_patterns_of_several_parts_take_time_in_proportion(spark):
    """Tried at all places of all parts, the first text alone takes minutes."""
    rows = [(1, "of th " * 20000), (2, "of the " * 20000 + "license"), (3, "license of th"), (4, "of\nthe license"), (5, "xa.b\\c%d_")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    index = trigrams.build(docs, blocks=2)
    found = lambda p: sorted(r.doc_id for r in trigrams.like(index, p).collect())
    began = time.perf_counter()
    assert [r.i for r in docs.select("doc_id", trigrams.matching(F.col("text"), "%of%th_%license%").alias("i")).orderBy("doc_id").collect()] == [False, True, False, True, False]
    assert time.perf_counter() - began < 20 and found("%of%th_%license%") == [2, 4]
    assert found("of%license") == [2, 4] and found("%of%th") == [3] and found("license_of th") == [3] and found("%license%license%") == []
    assert found("xa.b\\\\c\\%d\\_") == [5] and found("xa_b%") == [5] and found("%c\\%_\\_") == [5] and found("xaxb%") == []
    with pytest.raises(ValueError, match="escape"):
        trigrams.like(index, "%a\\b%")


def test_slices_are_bounded_and_texts_cut_where_long(spark, monkeypatch):
    assert trigrams.codes("ab").size == 0 and sorted(trigrams.codes("abcabc\U0001f600").tolist()) == sorted({trigrams.codes(g)[0] for g in ("abc", "bca", "cab", "bc\U0001f600")})
    monkeypatch.setattr(trigrams, "SLICE_CHARS", 7)
    assert trigrams.codes("the quick brown fox").tolist() == sorted(trigrams.codes(g)[0] for g in {"the quick brown fox"[i : i + 3] for i in range(17)})
    docs = spark.createDataFrame([(i, "abc" if i % 2 else "xyz") for i in range(400)], "doc_id int, text string").repartition(1)
    index = trigrams.build(docs, blocks=2)
    assert index.grams.where("gram <> -1").agg(F.max(F.size("held"))).first()[0] <= trigrams.SLICE
    assert sorted(r.doc_id for r in trigrams.contains(index, "ABC").collect()) == list(range(1, 400, 2))
