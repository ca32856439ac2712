"""Clusters against a full scan in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import clustering
from tests import oracle

SF = "/root/testdata/sf0.001"


def plain(rows, k=16, rounds=3, dim=64, scale=64):
    """Sorted (id, cluster, distance, cluster_inertia, inertia, centroid) of (id, vector) rows."""
    kept = [(i, tuple(max(-(1 << 63), min((1 << 63) - 1, math.floor(scale * x))) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=seed)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if members:
                centroids[n] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    last = [nearest(v) for _, v in kept]
    of = {n: sum(d for d, o in last if o == n) for n in range(len(centroids))}
    return sorted(((i, n, d, of[n], sum(of.values()), centroids[n]) for (i, _), (d, n) in zip(kept, last, strict=True)), key=str)


def got(df, **options):
    return sorted(((r[0], r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in clustering.clusters(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 12]]) for i in range(400)]
    rows += [(400 + i, [float(rng.randrange(-1, 2)) / 4 for _ in range(8)]) for i in range(200)]  # ties
    return rows


@pytest.mark.parametrize(("k", "rounds", "bounds"), [(16, 3, None), (16, 6, 1), (16, 5, 15), (2, 3, None), (1, 2, None), (40, 4, 3)])
def test_results_are_those_of_a_full_scan(spark, vectors, k, rounds, bounds):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    assert got(df, k=k, rounds=rounds, dim=8, bounds=bounds) == plain(vectors, k, rounds, 8)


def test_bounds_save_distances_and_adapt(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(16)]
    df = spark.createDataFrame([(i, [x + rng.gauss(0, 0.1) for x in centres[i % 16]]) for i in range(600)], "vec_id long, embedding array<double>")
    tally = []
    clustering.clusters(df, k=16, rounds=6, dim=8, tally=tally)
    assert tally[0]["computed"] == tally[0]["of"] and sum(t["computed"] for t in tally[1:]) < sum(t["of"] for t in tally[1:]) / 2
    assert tally[-1]["computed"] < tally[-1]["of"] / 4 and tally[-1]["bounds"] <= tally[0]["bounds"], tally


def test_query(spark):
    assert not oracle.differences(clustering.op11_clustering(spark, SF), clustering.OP11_SQL, oracle.connect(SF))


def test_odd_vectors_repeated_rows_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, -1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [-0.01, 0.0]), (None, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "id": F.lit(1), "v": F.lit(2)})
    assert got(df, k=3, dim=2) == plain(rows, 3, 3, 2) and len(plain(rows, 3, 3, 2)) == 5
    assert got(df, k=50, dim=2) == plain(rows, 50, 3, 2)
    assert clustering.clusters(df.limit(0), dim=2).count() == 0 and clustering.clusters(df, dim=9).count() == 0


def test_large_components(spark):
    rows = [(i, [float(i % 5) * 2.0**40, -(2.0**30) * (i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(i, n, min(d, clustering.LONGEST), min(a, clustering.LONGEST), min(b, clustering.LONGEST), c) for i, n, d, a, b, c in plain(rows, 4, 2, 2)]
    assert got(df, k=4, rounds=2, dim=2) == want
    assert clustering.squared(np.array([[1 << 40, 0]]), np.array([[0, 0]]))[0, 0] == 1 << 80
