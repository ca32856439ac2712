"""The store of changes against a dictionary, and writers that die."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.changes import ChangeStore

SCHEMA = "t string, o string, i int, text string"
KEY, SCOPE = ("t", "o", "i"), ("t", "o")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(((r.t, r.o, r.i, r.text) for r in df.collect()), key=str)


def files(path):
    return {p: p.stat().st_size for p in path.rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return ChangeStore(spark, str(tmp_path / "t"), KEY, SCOPE, 4)


def test_versions_are_those_of_a_dictionary(spark, store):
    rng = random.Random(2)
    some = lambda n, v: list({(t, o, i): (t, o, i, f"{v}-{t}{o}{i}") for t, o, i in ((rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(6)) for _ in range(n))}.values())
    first = some(25, 0)
    store.create(frame(spark, first))
    want = [{r[:3]: r for r in first}]
    for v in range(1, 9):
        now, change = dict(want[-1]), some(5, v)
        kind = rng.choice(["upsert", "keys", "scopes", "replace", "missing", "compact"]) if v > 5 else ["upsert", "keys", "scopes", "replace", "missing"][v - 1]
        if kind == "upsert":
            store.upsert(frame(spark, change))
            now.update({r[:3]: r for r in change})
        elif kind == "keys":
            store.delete_keys(frame(spark, change))
            now = {k: r for k, r in now.items() if k not in {c[:3] for c in change}}
        elif kind in ("scopes", "replace"):
            gone = {c[:2] for c in change}
            now = {k: r for k, r in now.items() if k[:2] not in gone}
            if kind == "scopes":
                store.delete_scopes(frame(spark, change))
            else:
                store.replace_scopes(frame(spark, change))
                now.update({r[:3]: r for r in change})
        elif kind == "missing":
            store.insert_missing(frame(spark, change))
            now = {**{r[:3]: r for r in change}, **now}
        else:
            store.compact()
        want.append(now)
    for v, table in enumerate(want):
        assert rows_of(store.read(v)) == sorted(table.values(), key=str)
    keys = frame(spark, [("a", "x", i, None) for i in range(3)])
    assert rows_of(store.read_keys(keys)) == sorted((r for k, r in want[-1].items() if k[:2] == ("a", "x") and k[2] < 3), key=str)


def test_a_change_writes_what_it_changes(spark, store, tmp_path):
    store.create(spark.range(20_000).select(F.lit("a").alias("t"), F.col("id").cast("string").alias("o"), F.lit(0).alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("text")))
    before = files(tmp_path)
    store.upsert(frame(spark, [("a", "7", 0, "new"), ("a", "7", 0, "old")]), order=F.length("text") * F.when(F.col("text") == "new", 2).otherwise(1))
    after = files(tmp_path)
    assert all(after[p] == n for p, n in before.items()) and len(after) - len(before) == 1 and sum(after.values()) - sum(before.values()) < 3000
    got = store.read()
    assert got.count() == 20_000 and [r.text for r in got.where("o = '7'").collect()] == ["new"]
    store.compact()
    assert store.vacuum() > 0 and store.read().where("text = 'new'").count() == 1 and len(store.history()) == 1
    with pytest.raises(FileNotFoundError):
        store.read(0)


@pytest.mark.parametrize("step", ["data", "manifest", "renamed"])
def test_a_writer_that_dies_blocks_nobody(spark, store, step):
    store.create(frame(spark, [("a", "x", 0, "first")]))

    class Dies(ChangeStore):
        def _step(self, name):
            if name == step:
                raise KeyboardInterrupt

    dying = Dies(spark, store.path, KEY, SCOPE, 4)
    with pytest.raises(KeyboardInterrupt):
        dying.upsert(frame(spark, [("a", "x", 0, "died"), ("a", "x", 1, "died")]))
    whole = [("a", "x", 0, "died"), ("a", "x", 1, "died")] if step == "renamed" else [("a", "x", 0, "first")]
    assert rows_of(store.read()) == whole
    store.upsert(frame(spark, [("a", "x", 2, "next")]))
    assert rows_of(store.read()) == [*whole, ("a", "x", 2, "next")]
    store.compact()
    store.vacuum()
    assert rows_of(store.read()) == [*whole, ("a", "x", 2, "next")]


def test_two_writers(spark, store):
    """Who comes second takes the next version, or fails if it names the version that it began from."""
    store.create(frame(spark, [("a", "x", 0, "first")]))

    class Slow(ChangeStore):
        def _step(self, name):
            if name == "manifest" and not getattr(self, "passed", False):
                self.passed = True
                store.upsert(frame(spark, [("a", "x", 0, "quick"), ("a", "x", 1, "quick")]))

    slow = Slow(spark, store.path, KEY, SCOPE, 4)
    assert slow.upsert(frame(spark, [("a", "x", 0, "slow")])) == 2
    assert rows_of(store.read()) == [("a", "x", 0, "slow"), ("a", "x", 1, "quick")]
    bound = Slow(spark, store.path, KEY, SCOPE, 4)
    with pytest.raises(RuntimeError):
        bound.upsert(frame(spark, [("a", "x", 9, "lost")]), of=2)
    assert rows_of(store.read()) == [("a", "x", 0, "quick"), ("a", "x", 1, "quick")]
    with pytest.raises(RuntimeError):
        store.create(frame(spark, []))
    with pytest.raises(FileNotFoundError):
        ChangeStore(spark, store.path + "-none").read()
