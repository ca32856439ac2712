"""Lexical rank against covers that are sought one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.session import written


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def rank(words, terms):
    """Every stretch that holds all terms and no shorter one that does."""
    whole = lambda i, j: set(terms) <= set(words[i:j])
    total = 0.0
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            if whole(i, j):
                if not whole(i + 1, j):
                    total += lexical.WEIGHT / (1 + sum(w not in terms for w in words[i:j]))
                break
    return round(total, 9)


def expected(docs, queries, k):
    out = []
    for q, text in queries:
        terms = set(words_of(text))
        found = [(-rank(words_of(t), terms), i) for i, t in docs] if terms else []
        out += [(q, n + 1, i, -r) for n, (r, i) in enumerate(sorted(x for x in found if x[0] < 0)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "x", "y", "z", "Über-maß"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, "alpha beta " * 200), (903, "alpha"), (904, "gamma delta alpha beta")]


QUERIES = [(1, "alpha"), (2, "alpha beta"), (3, "BETA gamma delta"), (4, "alpha beta gamma delta"), (5, "über maß"), (6, "absent alpha"), (7, ""), (8, "... !"), (9, "alpha alpha")]


def test_ranks_are_those_of_all_covers(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = written(lexical.build(df, block_docs=20), "lexical")
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    for k in (1, 5, 1000):
        got = sorted(tuple(r) for r in lexical.search(index, asked, k).collect())
        assert got == expected(docs, QUERIES, k)
    assert {r.id: r["rank"] for r in lexical.ranks(index, "alpha beta").collect()} == {i: r for _, _, i, r in expected(docs, [(0, "alpha beta")], 1000)}


def test_bounds_leave_blocks_out(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = written(lexical.build(df, block_docs=10), "lexical")
    seen = {}
    got = [tuple(r) for r in lexical.search(index, spark.createDataFrame([(1, "alpha beta")], "query_id int, query string"), 1, seen=seen).collect()]
    assert got == expected(docs, [(1, "alpha beta")], 1) and seen["scored"] < seen["blocks"] / 2


def test_texts_are_not_read_by_a_search(spark, docs, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    index = written(lexical.build(spark.read.parquet(str(tmp_path / "texts"))), "lexical")
    plan = lexical.search(index, spark.createDataFrame([(1, "alpha")], "query_id int, query string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_keywords_stand_behind_the_text(spark):
    rows = [(1, "alpha", "beta gamma"), (2, "alpha words between beta", None), (3, None, "alpha beta"), (3, None, "alpha beta")]
    index = written(lexical.build(spark.createDataFrame(rows, "doc_id int, text string, keywordsText string"), keywords="keywordsText"), "lexical")
    got = [(r.id, r["rank"]) for r in lexical.search(index, spark.createDataFrame([(1, "alpha beta")], "query_id int, query string"), 9).orderBy("place").collect()]
    assert got == [(1, 0.1), (3, 0.1), (3, 0.1), (2, round(0.1 / 3, 9))]
    empty = written(lexical.build(spark.createDataFrame([], "doc_id int, text string")), "lexical")
    assert lexical.search(empty, spark.createDataFrame([(1, "alpha")], "query_id int, query string"), 3).count() == 0


def test_postings_are_not_moved_once_a_query(spark, docs):
    """An index is made without an exchange, queries of the same terms are scored once, and of a block k hits go on."""
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    made = lexical.build(df, block_docs=50)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    index = written(made, "lexical")
    asked = [(i, ("alpha beta", "beta ALPHA", "x alpha")[i % 3]) for i in range(30)]
    seen = {}
    got = sorted(tuple(r) for r in lexical.search(index, spark.createDataFrame(asked, "query_id int, query string"), 2, first_blocks=100, seen=seen).collect())
    assert got == expected(docs, asked, 2) and seen["blocks"] == 2 * index.select("block").distinct().count() == seen["scored"]
    terms = spark.createDataFrame([(0, b.block, ["alpha"]) for b in index.select("block").distinct().collect()], "asked long, block long, t array<string>")
    assert lexical._scored(terms, index, 2).count() <= 2 * terms.count() < lexical._scored(terms, index).count()


def test_queries_of_a_block_are_scored_together_and_weak_documents_not_at_all(monkeypatch):
    """Each query was scored by itself in each block, with all documents that have its terms."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(rng.choice([None, 3, i]), [rng.choice("abcdefg") for _ in range(rng.choice([3, 9, 60]))]) for i in range(120)]
    block = lexical.postings([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(range(7, 127)), pa.array([r[1] for r in rows])], names=["id", "row", "words"])])
    queries = [rng.sample("abcdefgz", n) for n in (1, 1, 2, 2, 2, 2, 3, 3, 4, 7)]
    pairs, ranks = [], lexical._ranks
    monkeypatch.setattr(lexical, "_ranks", lambda *a: pairs.append(len(a[0])) or ranks(*a))

    def got(k, kth=None):
        asks = pa.RecordBatch.from_arrays([pa.array(queries), pa.array(range(len(queries))), pa.array([kth] * len(queries), pa.float64())], names=["t", "asked", "kth"])
        made = [r for b in lexical.best_of(7, [block.slice(0, 3), block.slice(3)], [asks.slice(0, 4), asks.slice(4)], k) for r in zip(*b.to_pydict().values(), strict=True)]
        return sorted(made, key=lambda r: (r[0], -r[3], r[1] is not None, r[1] or 0, r[2]))

    def want(k):
        found = [(q, i, n + 7, rank(w, set(t))) for q, t in enumerate(queries) for n, (i, w) in enumerate(rows)]
        found = sorted((r for r in found if r[3]), key=lambda r: (r[0], -r[3], r[1] is not None, r[1] or 0, r[2]))
        return [r for r in found if k is None or sum(x[0] == r[0] for x in found[: found.index(r)]) < k]

    assert got(None) == want(None) and len(pairs) <= 4
    assert got(2) == want(2)
    every = sum(pairs) // 2
    pairs.clear()
    assert [r for r in got(2, 1.0) if r[3] >= 1] == [r for r in want(2) if r[3] >= 1] and sum(pairs) < every / 2
    for size in (1, 50):
        monkeypatch.setattr(lexical, "CANDIDATES", size)
        monkeypatch.setattr(lexical, "OCCURRENCES", size)
        assert got(None) == want(None) and got(2) == want(2)


def test_long_documents_are_a_block(spark):
    """Blocks of documents of all lengths have nearly the same bounds, so that none was left out."""
    docs = [(i, "alpha beta " * (200 if i % 10 == 0 else 2)) for i in range(200)]
    index = written(lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_docs=20), "lexical")
    assert sorted(r.most for r in index.where("term = 'alpha'").collect()) == [2] * 9 + [200]
    seen = {}
    got = sorted(tuple(r) for r in lexical.search(index, spark.createDataFrame([(1, "alpha beta")], "query_id int, query string"), 5, seen=seen, first_blocks=1).collect())
    assert got == expected(docs, [(1, "alpha beta")], 5) and seen == {"blocks": 10, "scored": 1}


def test_postings_are_moved_to_their_block_alone(spark, docs):
    """The join that leaves out other blocks moved all postings of all queries once more."""
    index = written(lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), block_docs=50), "lexical")
    wanted = written(index.select(F.lit(0).cast("long").alias("asked"), "block", F.array(F.lit("alpha")).alias("t")).distinct(), "wanted")
    plan = lexical._scored(wanted, index, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 == plan.count("Exchange hashpartitioning") and "SortMergeJoin" not in plan
