"""Language models, chat formats, search and sketches against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, language_id, pivot_search, sketches

SF = "/root/testdata/sf0.01"


def kneser_ney(counts):
    """The same model, written with dictionaries: bits of a word."""
    order = language_id.ORDER
    grams = [Counter() for _ in range(order)]
    for word, n in counts.items():
        s = f" {word} "
        for i in range(1, len(s)):
            for k in range(1, min(i + 1, order) + 1):
                grams[k - 1][s[i - k + 1 : i + 1], i - k + 1 == 0] += n
    c = [dict(g) for g in grams]
    for k in range(order - 1):
        more = Counter(s[1:] for s, _ in grams[k + 1])
        for s, opens in c[k]:
            if not opens and more[s]:
                c[k][s, opens] = more[s]
    once = [max(1, list(x.values()).count(1)) for x in c]
    d = [min(0.95, max(0.1, a / (a + 2 * max(1, list(x.values()).count(2))))) for a, x in zip(once, c, strict=True)]
    total, kinds = [Counter() for _ in c], [Counter() for _ in c]
    for k, x in enumerate(c):
        for (s, opens), n in x.items():
            total[k][s[:-1], opens] += n
            kinds[k][s[:-1], opens] += 1

    def p(s, k, opens):
        ctx = s[:-1], opens
        low = 1 / (len(c[0]) + 1) if k == 1 else p(s[1:], k - 1, False)
        if not total[k - 1][ctx]:
            return low
        return max(c[k - 1].get((s, opens), 0) - d[k - 1], 0) / total[k - 1][ctx] + d[k - 1] * kinds[k - 1][ctx] / total[k - 1][ctx] * low

    def bits(word):
        s = f" {word} "
        return -sum(math.log2(p(s[max(0, i - order + 1) : i + 1], min(i + 1, order), i + 1 <= order)) for i in range(1, len(s)))

    return bits


def test_models_are_kneser_ney():
    rng = random.Random(2)
    made = {lang: Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(400)) for lang, letters in {"a": "abcde", "b": "bcdeéxy"}.items()}
    models = language_id.train({lang: (sorted(c), [c[w] for w in sorted(c)]) for lang, c in made.items()})
    words = ["a", "zz", "éxyé", "abcdeabcde", *list(made["a"])[:80], *list(made["b"])[:80]]
    got = models.word_scores(words)
    for k, lang in enumerate(models.languages):
        bits = kneser_ney(made[lang])
        assert np.allclose(got[:, k], [bits(w) for w in words], atol=1e-3)


def test_language_of_held_out_documents(spark):
    out = language_id.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.rejected.mean() < 0.01 and out.score.between(0, 1).all()


def test_language_edge_cases(spark):
    learned = spark.read.parquet(f"{SF}/documents.parquet")
    models = language_id.learn(learned)
    texts = ["", None, "123 ... !", "the and of " * 3, "Ω" * 400 + " ж" * 300, "x" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "the")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = {r.doc_id: r for r in language_id.predict(df, models).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].rejected for i in range(3))
    assert rows[3].lang_pred == "en" and not rows[3].rejected and rows[4].rejected and len(rows) == 7
    none = language_id.learn(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(df.limit(0), models).count() == 0


FOREIGN = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга.",
}


def test_rejection_by_a_stated_rate(spark):
    """Of the languages' own held-out texts about FALSE_REJECTION go, mixtures of them stay, and junk goes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = language_id.learn(docs.where(~language_id.held_out()))
    own = docs.where(language_id.held_out()).select("doc_id", "text", "lang")
    n, gone = language_id.predict(own, models).agg(F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 1500 and gone <= max(6, 3 * language_id.FALSE_REJECTION * n)
    long = own.where("length(text) > 400").selectExpr("lang", "substring(text, 1, 300) as text", "row_number() over (partition by lang order by doc_id) as i").where("i <= 60")
    mixed = long.where("lang = 'en'").join(long.where("lang = 'de'").select(F.col("text").alias("other"), "i"), "i").select(F.concat("text", F.lit(" "), "other").alias("text"))
    assert language_id.predict(mixed, models).where("rejected").count() <= 1
    rng = random.Random(3)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    junk = [words(letters, n) for letters in ("abcdefghijklmnopqrstuvwxyz", "eeeeeaaaaiiioooonnnnrrrsssttttllddcumph") for n in (20, 80) for _ in range(50)]
    assert language_id.predict(spark.createDataFrame([(t,) for t in junk], "text string"), models).where("rejected").count() >= 0.99 * len(junk)
    foreign = spark.createDataFrame(list(FOREIGN.items()), "lang string, text string")
    assert language_id.predict(foreign, models).where("rejected").count() == len(FOREIGN)


def test_numbers_are_no_letters(spark):
    models = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["½", "² 3", "②", "Ⅷ 12", "_", "\u0301", "the ½ and of ② the"]
    rows = language_id.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), models).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.i)] == ["und"] * 6 + ["en"]


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(4)
    marks = ["<", "|", "\\", "im_start", "im_end", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "[", "/", "s>", "x", "\n", "é"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e")).withColumn("u", chat_format.unescaped(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and "<|" not in r.e and "</s>" not in r.e and "[INST]" not in r.e


def test_chat_layouts(spark):
    turns = [("user", "hi </s>"), ("assistant", "yo <|im_end|>")]
    tables = [
        spark.createDataFrame([(1, 1, turns[1][0], turns[1][1], "x"), (1, 0, turns[0][0], turns[0][1], "x"), (2, 0, None, None, "x")], "conv_id long, turn long, role string, text string, segments string"),
        spark.createDataFrame([([{"role": r, "content": t} for r, t in turns],), (None,)], "messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([([{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns],)], "conversations array<struct<from:string,value:string>>"),
        spark.createDataFrame([(turns[0][1], turns[1][1])], "prompt string, response string"),
        spark.createDataFrame([("hi", "</s>", turns[1][1]), (None, None, "")], "instruction string, input string, output string"),
    ]
    for i, df in enumerate(tables):
        rows = chat_format.read_back(chat_format.format_chats(df)).collect()
        got = next([(t.role, t.text) for t in r.turns] for r in rows if len(r.turns) == 2)
        assert got == ([("user", "hi\n\n</s>"), turns[1]] if i == 4 else turns)
        assert {r.loss_text for r in rows} <= {turns[1][1], ""}
    assert chat_format.layout_of(tables[0]).name == "turn_rows" and chat_format.format_chats(tables[0].limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.format_chats(spark.range(1))
    plan = chat_format.read_back(chat_format.format_chats(tables[0]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query_against_plain(spark):
    con = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        con.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    con[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in chat_format.op3_chat_format(spark, SF).collect()}
    assert rows.keys() == con.keys()
    for i, turns in con.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert (rows[i].n_turns, rows[i].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (rows[i].loss_chars, rows[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_top_k_is_that_of_brute_force(spark, monkeypatch):
    for name, value in (("ANNULUS", 40), ("QUERY_BLOCK", 7), ("SLICE", 3), ("PIVOTS", 5)):
        monkeypatch.setattr(pivot_search, name, value)
    rng = np.random.default_rng(6)
    vectors = [list(map(float, v)) for v in rng.normal(size=(400, 8)).round(2)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[20]) for i in range(400, 520)]
    rows += [(600, None), (601, [1.0] * 7 + [None]), (602, [1.0] * 7 + [math.nan]), (603, [math.inf] * 8), (604, [0.0] * 8), (620, [3.0, 4.0]), (640, []), (None, vectors[0]), (20, vectors[20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"dim": F.lit("clash"), "rank": F.lit(0)})
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in pivot_search.top_k(df.repartition(6), F.col("vec_id") % 20 == 0, 20).collect())
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, x in dict(((i, tuple(v)), v) for i, v in whole if i % 20 == 0).items():
        best = sorted((-int(x @ v), i) for i, v in whole if i != q[0] and len(v) == len(x))[:20]
        want.update((q[0], n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert {k: 1 for k in got} == {k: 1 for k in want}
    assert pivot_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_components(spark, monkeypatch):
    """Scores beyond what a double holds are exact, ties and near ties too."""
    monkeypatch.setattr(pivot_search, "ANNULUS", 16)
    monkeypatch.setattr(pivot_search, "PIVOTS", 4)
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-(1 << 30), 1 << 30) >> rng.choice((0, 3, 24))) for _ in range(3)]) for i in range(300)]
    rows += [(300 + i, list(rows[i][1])) for i in range(40)] + [(400, [0.0] * 3), (401, None)]
    got = {}
    for r in pivot_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=7, scale=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for q, v in rows:
        if q % 10 == 0 and v is not None:
            scored = [(-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i) for i, w in rows if w is not None and i != q]
            want[q] = [(i, -s) for s, i in sorted(scored)[:7]]
    assert got == want


def test_fingerprints_against_plain(spark):
    """Every column of the query over all of the smallest table, and likenesses against the texts' own shingles."""
    import xxhash

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    def kept(text):
        hashes = set()
        for words in shingles(text):
            h = len(words)
            for w in words:
                h = ((h ^ xxhash.xxh64_intdigest(w, 42)) * 0x9E3779B97F4A7C15) % 2**64
                h ^= h >> 32
            hashes.add(h)
        return {h for h in hashes if h < 2**62} or ({min(hashes)} if hashes else set())

    def like(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    off = []

    got = {r.doc_id: r for r in sketches.op9_fingerprints(spark, sf).collect()}
    assert got.keys() == dict(rows).keys()
    prints = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert abs(r.near_edited - like(kept(text), kept(new))) < 1e-9 and abs(r.near_next - like(kept(text), kept(after))) < 1e-9
        if len(shingles(text)) > 200:
            off.append(abs(r.near_edited - like(shingles(text), shingles(new))))
        for t, f in ((text, r.fingerprint), (new, r.edited_fingerprint)):
            assert prints.setdefault(f, kept(t)) == kept(t)
    assert len(set(prints)) == len({frozenset(x) for x in prints.values()}) and len(off) > 50 and np.mean(off) < 0.05


def test_sketches_merge_and_estimate():
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    a, b = sketches.sketch(" ".join(words)), sketches.sketch(" ".join(words[1000:3000]))
    assert abs(sketches.containment(b, a) - 1) < 0.01 and abs(sketches.containment(a, b) - 0.5) < 0.06
    assert abs(sketches.likeness(a, b) - 0.5) < 0.06 and sketches.likeness(a, a) == 1
    both = sketches.merge(sketches.sketch(" ".join(words[:2004])), sketches.sketch(" ".join(words[2000:])))
    assert np.array_equal(both, a) and np.array_equal(sketches.from_text(sketches.text_form(a)), a)
    empty = sketches.sketch(" \n")
    assert len(empty) == 0 and sketches.likeness(empty, empty) == 1 and sketches.likeness(empty, a) == 0 and len(sketches.sketch("one")) == 1


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_documents(spark, parts):
    rng = random.Random(parts)
    texts = ["".join(rng.choice("ab cdé😀") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, ""]
    rows = [(i * 5 - 50, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("clash"), "id": F.lit("x")})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.id: r for r in sketches.compare_with_next(df.repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        own, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        new = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        r = got[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == sketches.text_form(sketches.sketch(own)) and r.edited_fingerprint == sketches.text_form(sketches.sketch(new))
        assert r.near_next == sketches.likeness(sketches.sketch(own), sketches.sketch(after))


def test_next_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "z"), (2, None)], "doc_id long, text string")
    assert sorted(str(r.id) for r in sketches.compare_with_next(df).collect()) == ["1", "1", "2", "None"]
    assert sketches.compare_with_next(df.limit(0)).count() == 0 and sketches.compare_with_next(df.limit(1)).count() == 1
