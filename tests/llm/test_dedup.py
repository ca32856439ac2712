"""Near duplicates and repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, near_copies, repeats, simhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def print_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    parts = [] if not words else [" ".join(words)] if len(words) < k else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def groups(prints, most):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh É\x1f".replace(" ", "")) for _ in range(rng.randint(1, 7))) for _ in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    for t in list(base[:25]):
        parts = t.split(" ")
        parts[rng.randrange(len(parts))] = "EDIT"
        base += [" ".join(parts), t.upper(), t]
    return base + ["", "  \t", "one two three", "one two three four", "\x85nbsp\xa0x"]


def test_groups_are_those_of_brute_force(spark):
    texts = corpus()
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(5000, None), (5000, None), (None, texts[0]), (None, "alone without an id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "node": F.lit(1)})
    got = simhash.near_duplicates(df.repartition(5), k=4, max_distance=4, words=1).collect()
    prints = [print_of(t, 4) for _, t in rows]
    label = groups(prints, 4)
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, p, least.get(g)) for (i, _), p, g in zip(rows, prints, label, strict=True))
    assert Counter((r.doc_id, r.fp[0] & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0), k=4, max_distance=4, words=1).count() == 0


@pytest.mark.parametrize(("block", "segments", "radius"), [(4096, simhash.SEGMENTS, 1), (7, simhash.SEGMENTS, 1), (4096, simhash.WIDE, 2), (20, simhash.WIDE, 2)])
def test_blocks_lose_no_link(spark, block, segments, radius):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {s for s in seeds}
    for s in seeds:
        for _ in range(40):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p, [p]) for p in signed], "node long, fp array<long>")
    edges = simhash.links(df, 4, segments=segments, block=block, radius=radius)
    assert edges.count() <= (40 if radius == 1 else 400) * len(prints)
    found = {r.node: r.root for r in components.components(edges).collect()}
    label = groups([p & (1 << 64) - 1 for p in signed], 4)
    least = {}
    for p, g in zip(signed, label, strict=True):
        least[g] = min(least.get(g, p), p)
    assert all(found.get(p, p) == least[g] for p, g in zip(signed, label, strict=True))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 3), (5, 5), (None, 1), (7, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 100: 0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows, n = [], 0
    for _ in range(60):
        base = [word() for _ in range(300)]
        near = list(base)
        for at in rng.sample(range(300), 3):
            near[at] = word()
        far = [w if rng.random() < 0.5 else word() for w in base]
        rows += [(n, " ".join(base)), (n + 1, " ".join(near)), (n + 2, " ".join(far))]
        n += 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert all(i in kept for i in range(0, n, 3)) and all(i in kept for i in range(2, n, 3))
    assert sum(i not in kept for i in range(1, n, 3)) >= 58


def test_links_are_exact_similarities(spark):
    """Groups at similarity 0.8 are those of brute force, with pairs on both sides of it and chains."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.016, 0.02, 0.025, 0.03, 0.05):
            base = list(base) if rng.random() < 0.5 else texts[-1].split()
            texts.append(" ".join(word() if rng.random() < share else w for w in base))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(texts))]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, " ")], "doc_id long, text string")
    for block in (256, 2):
        got = {r.doc_id: r.component_id for r in near_copies.similar_groups(df.repartition(3), block=block).collect()}
        assert got == {**dict(enumerate(want)), 900: 900, 901: 900}
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {*want, 900}
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Candidates come from multi-index hashing alone, and pairs of a similarity of just 0.8 are among them: 80 of 100
    shingles, and four of five. Fingerprints are majorities, at a tie the least hash's bits."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(400):
        head, few = [word() for _ in range(84)], [word() for _ in range(9)]
        texts += [" ".join(head + [word() for _ in range(10)]), " ".join(head + [word() for _ in range(10)]), " ".join(few), " ".join(few[:8])]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(k["by"]) or links(*a, **k))
    got = {r.doc_id: r.component_id for r in near_copies.similar_groups(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))} and {w for ws in asked for w in ws} == set(range(2 * near_copies.WORDS))
    sets = [np.sort(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 2, 5, 300, 255, 511)]
    made = near_copies.majorities(np.concatenate(sets), np.array([len(s) for s in sets]), 3)
    for s, row in zip(sets, made, strict=True):
        h = s
        for w in range(3):
            h = (h ^ (h >> np.uint64(31))) * near_copies.MIX
            h = h ^ (h >> np.uint64(29))
            ints = [int(x) for x in h]
            votes = [2 * sum(x >> b & 1 for x in ints) + (ints[0] >> b & 1) > len(ints) for b in range(64)]
            assert int(row[w]) & (1 << 64) - 1 == sum(1 << b for b, v in enumerate(votes) if v)


@pytest.mark.parametrize("block", [4096, 20])
def test_equal_segments_meet_in_blocks(spark, block, monkeypatch):
    """Of radius 0 each pair of a bucket is compared, in blocks where the bucket is large and across Arrow batches."""
    monkeypatch.setattr(simhash, "SHARE", 1)
    rng = random.Random(5)
    seed, prints = rng.getrandbits(64), set()
    while len(prints) < 150:
        prints.add((seed ^ rng.getrandbits(48) << 16) - (1 << 63))
    prints = sorted(prints)
    df = spark.createDataFrame([(p, [p]) for p in prints], "node long, fp array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        edges = simhash.links(df, 14, segments=(16,), block=block, radius=0)
        found = {r.node: r.root for r in components.components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    label = groups([p & (1 << 64) - 1 for p in prints], 14)
    least = {}
    for p, g in zip(prints, label, strict=True):
        least[g] = min(least.get(g, p), p)
    assert len(least) < 150 and all(found.get(p, p) == least[g] for p, g in zip(prints, label, strict=True))


@pytest.mark.parametrize("block", [4096, 20])
@pytest.mark.parametrize("common", [True, False])
def test_labels_are_connected_already(spark, block, common, monkeypatch):
    """Nodes of one label aren't compared, and a bucket leaves no more links than connect its labels; a large bucket of one
    label is dealt by its rows. What links and labels connect is what brute force connects with the labels."""
    monkeypatch.setattr(simhash, "SHARE", 1)
    rng = random.Random(6)
    seed, prints = rng.getrandbits(64), set()
    while len(prints) < 150:
        prints.add((seed ^ rng.getrandbits(48) << 16) - (1 << 63))
    prints = sorted(prints)
    label = {p: (prints[0] if i % 10 and i < 149 else p) if common else prints[i % 7] for i, p in enumerate(prints)}
    df = spark.createDataFrame([(p, [p], label[p]) for p in prints], "node long, fp array<long>, label long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        edges = [tuple(r) for r in simhash.links(df, 18, segments=(16,), block=block, radius=0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unsigned = lambda p: p & (1 << 64) - 1
    assert edges and all(label[a] != label[b] and (unsigned(a) ^ unsigned(b)).bit_count() <= 18 for a, b in edges)

    def connected(pairs):
        root = {p: p for p in prints}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in [*pairs, *label.items()]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(p) for p in prints]

    every = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (unsigned(a) ^ unsigned(b)).bit_count() <= 18]
    assert connected(edges) == connected(every)


def test_trees_connect_what_links_connect():
    rng = np.random.default_rng(3)
    for n, m in ((2, 1), (30, 20), (30, 200), (400, 380)):
        a = rng.integers(0, n, m)
        b = (a + rng.integers(1, n, m)) % n
        tree = simhash._tree(a * 3, b * 3)
        assert (simhash._labels(a[tree], b[tree], n) == simhash._labels(a, b, n)).all()
        assert len(tree) == n - len(np.unique(simhash._labels(a, b, n)))


def test_candidates_of_a_group_grow_with_its_size(spark, monkeypatch):
    """Near copies of one text leave some pairs for each of them, not one for each bucket that they meet in."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, asked, verified = [word() for _ in range(200)], [], near_copies.verified
    texts = [" ".join(word() if rng.random() < 0.005 else w for w in base) for _ in range(300)]
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: asked.append(pairs.count()) or verified(pairs, *a))
    made, components_of = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda edges: made.append(edges.count()) or components_of(edges))
    got = near_copies.similar_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert got.where("component_id = 0").count() >= 280 and asked[0] <= 8 * len(texts) and sum(made) <= 25 * len(texts)


def brute(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                cover[i] += 1
                cover[i + size] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int(gone.sum()), runs))
    return out


@pytest.mark.parametrize(("size", "kinds"), [(40, 3), (40, 1024), (400, 3), (400, 1024)])
def test_repeats_are_those_of_brute_force(spark, size, kinds, monkeypatch):
    monkeypatch.setattr(repeats, "KINDS", kinds)
    monkeypatch.setattr(repeats, "ORDERED", 20)
    rng = random.Random(size)
    text = lambda n, letters="abcdefgh é\n": "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randint(size // 2, 3 * size)) for _ in range(6)]
    texts = [None, None, "", "x" * (size - 1), "x" * size, "y" * (2 * size), "ab" * (2 * size), text(5), "é" * size]
    for _ in range(60):
        parts = [text(rng.randint(0, size))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : len(s) - rng.randint(0, len(s) // 3)], text(rng.randint(0, size))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-2] + "tail", text(4 * size) * 2]
    ids = [*range(len(texts) - 3), None, 7, 7]
    rows = [*zip(ids, texts, strict=True), (500, texts[20]), (500, texts[20])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"raw": F.lit("clash"), "th": F.lit(1), "id": F.lit(2)})
    got = repeats.remove_repeats(df.repartition(4), min_bytes=size).collect()
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], size), strict=True)]
    assert Counter((r.doc_id, hashlib.sha256(bytes(r.kept)).hexdigest(), len((r.text or "").encode()) - len(r.kept), len(r.removed)) for r in got) == Counter(want)
    assert repeats.remove_repeats(df.limit(0), min_bytes=size).count() == 0
    both = repeats.remove_repeats_of(df.repartition(4), {"": (size, False), "_short": (size * 5 // 8, False)}).collect()
    short = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], size * 5 // 8), strict=True)]
    for name, wanted in (("", want), ("_short", short)):
        assert Counter((r.doc_id, hashlib.sha256(bytes(r[f"kept{name}"])).hexdigest(), len((r.text or "").encode()) - len(r[f"kept{name}"]), len(r[f"removed{name}"])) for r in both) == Counter(wanted)


def test_passages_go_by_their_words(spark):
    """A repeated passage of over 50 short words goes, one of 50 words doesn't unless it has 250 bytes."""
    rng = random.Random(4)
    words = lambda n, k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)) for _ in range(n))
    short, few, long = words(55, 2), words(45, 3), words(40, 8)
    own = [words(30, 9) for _ in range(13)]
    texts = [f"{own[2 * i]} {p} {own[2 * i + 1]}" for i, p in enumerate((short, short, few, few, long, long))] + [own[12]]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats_of(df, {"": repeats.Cut(100, True, words=50, or_bytes=250)}).collect()}
    assert short not in got[0] and short not in got[1] and got[2] == texts[2] and got[3] == texts[3] and long not in got[4] and long not in got[5] and got[6] == own[12]
    assert repeats.whole_words(b"ab cd ef", 1, 7) == 1 and repeats.whole_words(b"ab cd ef", 2, 6) == 1 and repeats.whole_words(b"ab cd", 0, 5) == 2 and repeats.whole_words(b"abcd", 1, 3) == 0


def test_intermediate_tables_go_once_the_result_is_written(spark):
    import glob

    from tessera.llm import common

    at = f"{common.shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    before = set(glob.glob(f"{at}/*"))
    df = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(30)], "doc_id long, text string").withColumns({"stays": F.lit("clash"), "n": F.lit(1)})
    kept = simhash.drop_near_duplicates(df)
    names = sorted(p.rpartition("/")[2].rpartition("-")[0] for p in set(glob.glob(f"{at}/*")) - before)
    assert names == ["stays"] and kept.count() == 3 and "stays" in kept.columns
    repeats.remove_repeats(df, min_bytes=20)
    names = sorted(p.rpartition("/")[2].rpartition("-")[0] for p in set(glob.glob(f"{at}/*")) - before)
    assert names == ["repeats", "spans", "stays"] and spark.conf.get(common.SHUFFLES_GO) == "false"


def test_nothing_is_left_behind(spark):
    from tessera.llm import common

    df = spark.createDataFrame([(1, "x" * 900), (2, "x" * 900)], "doc_id long, text string")
    assert [len(r.kept) for r in repeats.remove_repeats(df).collect()] == [0, 0]
    assert any(t.name.startswith("tessera_") for t in spark.catalog.listTables())
    common.forget(spark)
    assert not any(t.name.startswith("tessera_") for t in spark.catalog.listTables())


def test_triggers_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = repeats.triggers(raw, 250)
    monkeypatch.setattr(repeats, "POSITION_BITS", 10)
    # fewer hash bits may tie differently, but every trigger stays within its stretch
    parts = repeats.triggers(raw, 250)
    assert len(whole) == len(parts) == 5000 - 7 - 249
    assert (parts >= np.arange(len(parts))).all() and (parts < np.arange(len(parts)) + 250).all()
