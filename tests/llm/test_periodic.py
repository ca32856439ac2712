"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic

SF = "/root/testdata/sf0.001"


def brute(words, least=24, periods=3):
    """All runs (start, length, period) by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(words, runs):
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = best and 1000 * best[1] // best[2]
    return (len(runs), *(best or (None,) * 3), milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return digest(words, brute(words))


def values(row):
    return (row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.runs_sha256, row.collapsed_sha256)


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def made(rng):
    kind = rng.randrange(7)
    few = lambda n, k: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    if kind == 0:
        return few(rng.randrange(200), rng.randrange(1, 4))
    if kind == 1:
        return few(rng.randrange(20), 5) + few(rng.randrange(1, 30), 5) * rng.randrange(1, 8) + few(rng.randrange(20), 5)
    if kind == 2:
        return (few(rng.randrange(1, 4), 2) * rng.randrange(5, 20) + few(3, 3)) * rng.randrange(1, 6)
    if kind == 3:
        return fibonacci(rng.randrange(300))
    if kind == 4:
        return ["x"] * rng.randrange(120) + ["y"] * rng.randrange(60)
    if kind == 5:
        return [str(bin(i).count("1") % 2) for i in range(rng.randrange(300))]
    base = few(rng.randrange(8, 40), 8)
    return base + few(2, 8) + base * 3 + few(5, 2) + base[:20] * 4


def test_runs_are_those_of_brute_force():
    rng = random.Random(7)
    lists = [made(rng) for _ in range(600)] + [["a"] * 23, ["a"] * 24, list("abcdefgh") * 3, list("abcdefghi") * 3, list("abcdefgh") * 2 + list("abcdefg"), []]
    got = periodic.find_runs(lists)
    assert got == [brute(x) for x in lists] and sum(map(len, got)) > 300
    for least, periods in ((6, 3), (10, 4)):
        assert periodic.find_runs(lists, least, periods) == [brute(x, least, periods) for x in lists]
    assert periodic.overlap(24, 3) == 16


def test_results_do_not_rest_on_hashes(monkeypatch):
    """With hashes that often agree on different words more is searched, and found stretches are mended."""
    lists = [made(random.Random(s)) for s in range(150)]
    monkeypatch.setattr(periodic, "HASHES", ((7, 3), (5, 2)))
    assert periodic.find_runs(lists) == [brute(x) for x in lists]


def test_query_on_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = periodic.op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_runs for r in got) > 10
    for r in got:
        assert values(r) == plain(r.doc_id, texts[r.doc_id])


def test_nulls_long_texts_repeated_rows_and_clashing_names(spark):
    long = " ".join(fibonacci(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "w " * 30), (4, "w " * 30), (None, "a b " * 20), (5, "é x " * 24), (6, long), (7, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "n_words": F.lit("clash"), "extra": F.lit(9)})
    out = periodic.periodic_runs(df.repartition(3)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(r.extra == 9 for r in out)
    assert all(by[i].n_words == 0 and by[i].runs == [] and by[i].strongest is None and by[i].collapsed == "" for i in (1, 2, 3))
    assert sum(r.doc_id == 4 and r.collapsed == "w" and r.strongest.asDict() == {"start": 0, "length": 30, "period": 1} for r in out) == 2
    assert by[None].collapsed == "a b" and by[5].collapsed == "é x" and by[7].collapsed == "one" and len(by[6].runs) > 100
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, periods=2)
    assert periodic.planted(None, ["a"]) == ["a"]
