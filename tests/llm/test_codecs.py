"""Exactness of ids, packing, files and archives."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, sentencepiece_codec, token_files, warc, word_tokens
from tessera.llm.common import fresh_path

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a b  ", "▁▁x▁", "\x00\x01é😀", "aaaa" * 300, " " * 90, "\n\n\t", "漢字かな", "<s></s><0x0A>", "don't I'll x.'s 5's ''s", "<|endoftext|>a<|ENDOFTEXT|>", "H̱ Σας İ", "a\x0b's\x0c\x1c\x85\xa0'LL ª"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    sets = ["abcdst STMLVERD", "'’.,-*$%<|>", " \n\t▁", "0129", "éÉàßŒ", "漢日̱́😀"]
    return ["".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def documents(spark, extra=True):
    rows = [(i, t) for i, t in enumerate(ODD + random_texts(40))] + [(900, None), (900, None), (None, "no id"), (7, ODD[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    return df.withColumns({"ids": F.lit("clash"), "start": F.lit(1), "key": F.lit(2)}) if extra else df


def test_pieces_are_the_librarys():
    m, sp = sentencepiece_codec.model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in ODD + random_texts(400):
        flat, _ = m.encode_words(m.words(t))
        assert flat.tolist() == sp.encode(t), t
        assert m.decode(flat) == sp.decode(flat.tolist())
    for ids in ([2], [3, 4, 200], [259, 259], [0, 5], [230, 28705], [198, 170, 28705], [1, 28705, 264], [200, 3, 264, 2]):
        assert m.decode(np.array(ids)) == sp.decode(ids), ids


def test_encode_decode(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = sentencepiece_codec.encode_decode(documents(spark), PIECES, end_id=2).collect()
    assert len(out) == documents(spark).count()
    assert all(r.ids == sp.encode(r.text or "") + [2] and r.decoded == sp.decode(r.ids) for r in out)
    assert sentencepiece_codec.encode_decode(documents(spark).limit(0), PIECES).count() == 0


def test_word_ids_are_the_librarys():
    t, encode = Tokenizer.from_file(WORDS), word_tokens.make_encoder(WORDS, None)
    for text in ODD + random_texts(600, 9):
        assert encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_cuts_fill_classes():
    for n in [*range(1, 300), 2047, 2048, 2049, 3000, 4095, 4096, 4097, 100_000]:
        parts = packing.cuts(n)
        assert sum(parts) == n and max(parts) <= 4096
        assert all(4096 // (4096 // p) - p <= max(4096 // (4096 // p) / 64, 16) for p in parts[:-1])


def test_pack(spark):
    t = Tokenizer.from_file(WORDS)
    long = " ".join(random_texts(300, 3))
    df = documents(spark).unionByName(spark.createDataFrame([(50_000, long)], "doc_id long, text string").withColumns({"ids": F.lit(""), "start": F.lit(0), "key": F.lit(0)}))
    rows = packing.pack(df, WORDS).collect()
    ids = Counter((r.doc_id, r.doc_tokens) for r in df.withColumn("doc_tokens", F.lit(0)).collect())
    assert {r.doc_id for r in rows} == {k[0] for k in ids}
    bins = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = [0]
        for at, n in sorted(parts):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 4096
    got = [r for r in rows if r.doc_id == 50_000]
    want = np.array([*t.encode(long, add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert b"".join(bytes(r.ids) for r in sorted(got, key=lambda r: r.start)) == want
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_every_id_is_packed_once(spark):
    """All documents of a table: pieces are gapless, hold the document's ids in order, and say how many it has."""
    t = Tokenizer.from_file(WORDS)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces, places = {}, {}
    for r in packing.op5_packing(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for held in places.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 4096


def test_remembered_words_are_bounded_by_characters():
    from tessera.llm.common import WordIds

    made = WordIds(lambda words: (np.array([ord(c) for w in words for c in w], np.int32), np.array([len(w) for w in words])), limit=100, most_chars=50)
    for n in range(40):
        words = [chr(97 + n % 26) * (1 + n % 30), "x", "x"]
        flat, lengths = made(words)
        assert "".join(map(chr, flat)) == "".join(words) and lengths.tolist() == [len(w) for w in words]
        assert made.chars <= 50 + 31


def test_token_files_of_ties_and_null_ids(spark):
    rows = [(None, "b"), (None, None), (1, "x y"), (1, "a"), (1, "m n o"), (2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    starts = []
    for parts in (1, 5):
        path = fresh_path(spark, "test-tokens")
        token_files.write_tokens(df.repartition(parts), path, WORDS)
        starts.append(sorted((r.key is not None, r.key or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.with_ids_crc32(token_files.read_tokens(spark, path)).collect()))
    assert starts[0] == starts[1] and len(starts[0]) == len(rows)
    assert [r[2] for r in starts[0]] == [sum(x[3] for x in starts[0][:k]) for k in range(len(rows))]


def test_padding_is_little(spark):
    g = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), WORDS).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    assert sum(4096 - n for n in g if n & (n - 1)) < 0.02 * g.sum()


def test_token_files(spark):
    t, path = Tokenizer.from_file(WORDS), fresh_path(spark, "test-tokens")
    df = documents(spark).where("doc_id is not null")
    token_files.write_tokens(df, path, WORDS)
    rows = token_files.with_ids_crc32(token_files.read_tokens(spark, path)).collect()
    texts = Counter((r.doc_id, r.text or "") for r in df.collect())
    crc = lambda text: zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert Counter((r.key, r.ids_crc32) for r in rows) == Counter({(i, crc(text)): n for (i, text), n in texts.items()})
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.key for r in sorted(rows, key=lambda r: r.start)] == sorted(r.key for r in rows)
    empty = fresh_path(spark, "test-tokens")
    token_files.write_tokens(df.limit(0), empty, WORDS)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_file_layout(spark):
    import glob

    import pyarrow.parquet as pq

    path = fresh_path(spark, "test-tokens")
    token_files.write_tokens(documents(spark).where("doc_id is not null"), path, WORDS)
    meta = pq.ParquetFile(next(f for f in glob.glob(f"{path}/*.parquet") if pq.ParquetFile(f).metadata.num_rows)).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    ids = next(v for k, v in columns.items() if k.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["key"].encodings
    assert ids.has_offset_index and columns["key"].has_column_index


PAGES = [(3, "http://x/ y\n", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "n", "same"), (8, "u", "é" * 40_000), (1, None, "same"), (9, "u", "\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 2])
def test_archives(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = fresh_path(spark, "test-warc")
    rows = warc.read_archives(spark, path, warc.write_archives(pages, path, least)).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)

    def want(i, _, h):
        h = h or ""
        f = first.get(h)
        back = None if f is None or f == i else f
        raw = h.encode()
        return (i, len(raw), warc.sha1_base32(raw), "revisit" if back is not None else "response", back, None if back is not None else raw)

    assert Counter(map(lambda p: want(*p), PAGES)) == Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows)
    empty = fresh_path(spark, "test-warc")
    assert warc.read_archives(spark, empty, warc.write_archives(pages.limit(0), empty)).count() == 0


def test_archive_has_its_dictionary(spark):
    pages = spark.createDataFrame([(i, "u", f"<html><body>{'boiler plate ' * 30}{i * 7919}</body></html>") for i in range(200)], "page_id long, url string, html string")
    path = fresh_path(spark, "test-warc")
    manifest = warc.write_archives(pages.coalesce(1), path)
    name = manifest.first().file
    system, top = warc._open(path)
    with system.open_input_file(f"{top}/{name}") as f:
        raw = f.read()
    assert raw[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(raw[4:8], "little") > 0
    assert sum(1 for _ in warc.read_file(raw)) == manifest.agg(F.sum("records")).first()[0] or manifest.count() > 1
    assert warc.read_archives(spark, path, manifest).count() == 200
