"""Golden cases and invariants of single operators."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import access
from tessera.functions import text as tx
from tessera.operators import chunking, context, filters, jobs, paging, relational, retrieval
from tessera.sources import files, markup, pages_text, store
from tessera.sources.statements import StatementCatalog


def docs(spark, *texts):
    return spark.createDataFrame([(f"doc-{i + 1}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def contents(df):
    return [r.content for r in df.orderBy("doc_id", "chunk_order").collect()]


@pytest.mark.parametrize(
    ("size", "overlap", "text", "want"),
    [(5, 0, "abcdefghijkl", ["abcde", "fghij", "kl"]), (5, 2, "abcdefgh", ["abcde", "defgh"]), (5, 0, "ab        cd", ["ab", "cd"]), (5, 0, " \n", [])],
)
def test_fixed(spark, size, overlap, text, want):
    made = chunking.fixed(docs(spark, text), sizes=chunking.Sizes(size, overlap))
    assert contents(made) == want
    rows = made.orderBy("chunk_order").collect()
    assert [r.chunk_id for r in rows] == [f"doc-1-{i}" for i in range(len(want))]
    assert [r.next_chunk_id for r in rows] == [r.chunk_id for r in rows[1:]] + [None] * bool(rows)


@pytest.mark.parametrize(
    ("size", "overlap", "text", "want"),
    [
        (12, 0, "alpha beta\n\ngamma delta", ["alpha beta", "gamma delta"]),
        (6, 0, "alpha beta gamma", ["alpha", "beta", "gamma"]),
        (10, 3, "alpha beta gamma", ["alpha beta", "eta gamma"]),
        (4, 0, "abcdefghij", ["abcd efgh"[:4], "efgh", "ij"]),
        (12, 0, "One two. Three four! Five", ["One two.", "Three four!", "Five"]),
    ],
)
def test_recursive(spark, size, overlap, text, want):
    made = contents(chunking.recursive(docs(spark, text), sizes=chunking.Sizes(size, overlap)))
    assert made == want
    assert all(len(c) <= size for c in made)


@pytest.mark.parametrize(
    ("size", "overlap", "text", "want"),
    [(10, 0, "abcdefghijklmnop", ["abcdefghij", "klmnop"]), (10, 3, "abcdefghijklmnop", ["abcdefghij", "hijklmnop"]), (32, 4, "alpha\n\nbeta", ["alpha\n\nbeta"])],
)
def test_overlapping(spark, size, overlap, text, want):
    assert contents(chunking.overlapping(docs(spark, text), sizes=chunking.Sizes(size, overlap))) == want


def test_sizes_and_strategies(spark):
    assert chunking.Sizes(0, -1) == chunking.Sizes(800, 100)
    assert chunking.Sizes(10, 50).overlap == 9
    with pytest.raises(ValueError):
        chunking.chunk(docs(spark, "x"), "semantic")


BLOCKS = "doc_id string, block_order int, block_id string, block_type string, text string, heading_path string, source_ref string, confidence double"


def structured(spark, rows, size=20, overlap=0):
    df = spark.createDataFrame([("d", i, f"b{i}", kind, text, None, f"r{i}", conf) for i, (kind, text, conf) in enumerate(rows)], BLOCKS)
    return chunking.structured(df, sizes=chunking.Sizes(size, overlap)).orderBy("chunk_order").collect()


def test_structured_sections(spark):
    rows = structured(spark, [("TITLE", "Empty", None), ("TITLE", "One", None), ("PARAGRAPH", "aaaa", 0.5), ("PARAGRAPH", "bbbb", 1.0), ("TABLE", "| t |", None), ("PARAGRAPH", "cccc", None), ("HEADING", "Two", None), ("PARAGRAPH", "x" * 30, None)])
    assert [(r.content, r.section, r.chunk_type, r.parent_chunk_id) for r in rows] == [
        ("aaaa\n\nbbbb", "One", "child", "d-parent-1"), ("| t |", "One", "table", "d-parent-1"), ("cccc", "One", "child", "d-parent-1"), ("x" * 30, "Two", "child", "d-parent-6"),
    ]
    assert rows[0].confidence == 0.75 and rows[0].block_ids == ["b2", "b3"] and rows[0].source_refs == ["r2", "r3"]
    assert rows[0].parent_content == "One\n\naaaa\n\nbbbb\n\n| t |\n\ncccc"
    assert [(r.prev_chunk_id, r.next_chunk_id) for r in rows] == [(None, "d-1"), ("d-0", "d-2"), ("d-1", None), (None, None)]


def test_structured_overlap(spark):
    rows = structured(spark, [("PARAGRAPH", t, None) for t in ("aaaaaaaa", "bbbb", "cccccc", "dddddddd")], size=14, overlap=5)
    assert [r.content for r in rows] == ["aaaaaaaa\n\nbbbb", "bbbb\n\ncccccc", "dddddddd"]


def test_text_functions(spark):
    row = spark.createDataFrame([("\x00 a\r\nb\r\n\r\n\r\n\r\nc\x07\t ",)], "t string").select(
        tx.clean_text(F.col("t")).alias("clean"), tx.token_estimate(F.lit(" \n ")).alias("blank"), tx.token_estimate(F.lit("ab  cd ef")).alias("tokens"),
        tx.first_seen(F.array(F.lit(" A b"), F.lit("a  B"), F.lit(""), F.lit("c"))).alias("seen"),
        tx.keyword_list(F.lit("x, y\nX")).alias("plain"), tx.keyword_list(F.lit('```json\n["p", "q", "P"]\n```')).alias("json"),
        tx.rewritten_query(F.lit('{"expanded_query": " a  b ", "keywords": ["k", "K"]}')).alias("object"), tx.rewritten_query(F.lit("u; v,w")).alias("listed"),
        tx.context_line(F.lit(1), F.lit("d"), F.lit(0.5), F.lit("c")).alias("line"),
        tx.token_usage(F.create_map(F.lit("prompt_tokens"), F.lit("7"), F.lit("x"), F.lit("-3")), "promptTokens", "prompt_tokens").alias("used"),
        tx.child_names(F.lit("a.b.c.d"), "a.b").alias("child"),
    ).first()
    assert row.clean == "a\nb\n\nc" and row.blank == 0 and row.tokens == 2
    assert row.seen == ["A b", "c"] and row.plain == ["x", "y"] and row.json == ["p", "q"]
    assert row.object.expanded_query == "a b" and row.object.keywords == ["k"] and row.listed.keywords == ["u", "v", "w"]
    assert row.line == "[1] docId=d score=0.500\nc\n\n" and row.used == 7 and row.child == "c"


def test_cascade_falls_through(spark):
    hits = lambda score: spark.createDataFrame([(1, score)], "query_id int, score double")
    assert retrieval.cascade([hits(0.1), hits(0.14), hits(0.2)]).first().stage == 2
    assert retrieval.cascade([hits(0.1)]).count() == 0
    calls = []
    stages = [lambda s=s: calls.append(s) or hits(s) for s in (0.1, 0.3, 0.9)]
    assert retrieval.single_cascade(stages).first().score == 0.3 and calls == [0.1, 0.3]


def test_neighbours_survive_cycles_and_gaps(spark):
    links = [("a", None, "b"), ("b", "a", "c"), ("c", "b", "a"), ("x", "gone", None)]
    chunks = spark.createDataFrame([("t", "1", *r) for r in links], "object_type string, object_id string, chunk_id string, prev_chunk_id string, next_chunk_id string")
    hits = spark.createDataFrame([(1, "t", "1", "a"), (2, "t", "1", "x")], "hit_id int, object_type string, object_id string, chunk_id string")
    got = {(r.hit_id, r.chunk_id): r.away for r in context.neighbours(hits, chunks, 5).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "x"): 0}


def test_expanded_routes(spark):
    rows = [("t0", "table", "p", "s"), ("p1", "child", "p", "s"), ("p2", "child", "p", "s"), ("s1", "child", None, "z"), ("s2", "child", None, "z"), ("w", "child", None, "")]
    chunks = spark.createDataFrame([("t", "1", *r, None, None) for r in rows], "object_type string, object_id string, chunk_id string, chunk_type string, parent_chunk_id string, section string, prev_chunk_id string, next_chunk_id string")
    hits = spark.createDataFrame([(i, "t", "1", c) for i, c in enumerate(("t0", "p1", "s1", "w"))], "hit_id int, object_type string, object_id string, chunk_id string")
    got = {}
    for r in context.expanded(hits, chunks).collect():
        got.setdefault(r.hit_id, set()).add(r.chunk_id)
    assert got == {0: {"t0"}, 1: {"t0", "p1", "p2"}, 2: {"s1", "s2"}, 3: {"w"}}


def test_context_stops_at_first_overflow(spark):
    hits = spark.createDataFrame([("g", "d", 1.0, "x" * n, i) for i, n in enumerate((10, 500, 5))], "g string, doc_id string, score double, content string, i int")
    assert [r.i for r in context.packed(hits, "g", [F.asc("i")], max_chars=200).collect()] == [0]


def test_ranges():
    with pytest.raises(ValueError):
        filters.Range()
    with pytest.raises(ValueError):
        filters.Range(2, 1)
    cleaned = filters.MetadataFilter({" a ": " x ", "b": " ", "objectType": "T"}, {"c": [1, "1", None, ""]}).cleaned()
    assert dict(cleaned.equals) == {"a": "x"} and dict(cleaned.among) == {"c": ["1"]} and cleaned.object_type == "T"


def test_job_state(spark):
    events = [(1, "JOB_CREATED", 0), (2, "JOB_STARTED", 0), (3, "CHUNKED", 4), (4, "WARN", 0), (5, "JOB_SUCCEEDED", 0), (5, "JOB_SUCCEEDED", 0)]
    log = lambda job, rows: [(job, e, f"2024-01-01 00:00:{e:02d}", c, v) for e, c, v in rows]
    rows = log("w", events) + log("c", [(11, "JOB_STARTED", 0), (12, "JOB_CANCELLED", 0), (13, "JOB_SUCCEEDED", 0)]) + log("r", [(21, "JOB_STARTED", 0), (22, "CHUNKED", 9), (23, "JOB_FAILED", 0), (24, "RETRY_REQUESTED", 0), (25, "JOB_STARTED", 0)])
    df = spark.createDataFrame(rows, "job_id string, event_id long, at string, code string, value long").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.job_id: r for r in jobs.state(df).collect()}
    assert (got["w"].status, got["w"].chunk_count, got["w"].warning_count, got["w"].duration_ms) == ("WARNING", 4, 1, 3000)
    assert got["c"].status == "CANCELLED" and (got["r"].status, got["r"].chunk_count, got["r"].retries, got["r"].duration_ms) == ("RUNNING", 0, 1, None)


def test_store_versions(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path / "t"))
    row = lambda i, t: spark.createDataFrame([("a", "1", i, t)], "object_type string, object_id string, chunk_index int, text string")
    assert s.version() == -1
    s.commit(row(0, "x").union(row(1, "y")))
    reader = s.read()
    for _ in range(2):
        s.commit(store.replace_scope(s.read(), row(5, "z")))
    assert [r.chunk_index for r in s.read().collect()] == [5] and s.version() == 2
    s.commit(store.upsert(s.read(), row(5, "w").union(row(6, "v"))))
    assert sorted(r.text for r in s.read().collect()) == ["v", "w"] and reader.columns
    with pytest.raises(RuntimeError):  # made from a version that is no longer current
        s.commit(row(9, "late"), of=s.version() - 1)
    assert sorted(r.text for r in s.read().collect()) == ["v", "w"] and s.version() == 3
    with pytest.raises(FileNotFoundError):
        store.TableStore(spark, str(tmp_path / "empty")).read()


def test_upserts_take_the_last_row_of_a_key(spark):
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, at int")
    old, new = rows((1, "old", 0), (2, "kept", 0)), rows((1, "a", 1), (1, "c", 3), (1, "b", 2), (3, "x", 1), (3, "y", 1), (None, "n", 1))
    assert {(r.k, r.v) for r in store.upsert(old, new, ["k"], F.col("at")).collect()} == {(1, "c"), (2, "kept"), (3, "y"), (None, "n")}
    assert {(r.k, r.v) for r in store.upsert(old, new, ["k"]).collect()} == {(1, "c"), (2, "kept"), (3, "y"), (None, "n")}
    assert {(r.k, r.v) for r in store.insert_missing(old, new, ["k"], F.col("at")).collect()} == {(3, "x"), (None, "n")}
    assert store.upsert(old, new.limit(0), ["k"]).count() == 2 and store.replace_scope(old, new, ["k"]).count() == 7


def test_html(spark):
    html = "<html><nav>no</nav><main><h1 id=t>Top</h1><p>One<p>Two <b>b</b><ul><li>It</li></ul><img alt=Pic><table><tr><th colspan=2>H<th rowspan=2>K<tr><th>a<th>b<tr><td>1<td>2<td>3</table></main><p>out</p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "doc_id long, html string")
    found, _ = markup.blocks(df, "doc_id", "html")
    rows = found.orderBy("block_order").collect()
    assert [(r.block_type, r.path, r.text) for r in rows[:5]] == [("TITLE", "h1#t", "Top"), ("PARAGRAPH", "p[1]", "One"), ("PARAGRAPH", "p[2]", "Two b"), ("LIST_ITEM", "li[3]", "It"), ("IMAGE_CAPTION", "img[4]", "Pic")]
    assert rows[5].text == "| H | K |\n| a | b |\n| 1 | 2 | 3 |"
    assert markup.table_text(found.where("block_type = 'TABLE'"), ["doc_id"]).first().vector_text == "H a: 1 | H b: 2 | K: 3"


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>L</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    docx = _zip(**{"word/document.xml": doc, "word/footer1.xml": f"<w:ftr {w}><w:p><w:r><w:t>F</w:t></w:r></w:p></w:ftr>"})
    df = spark.createDataFrame([(1, bytearray(docx)), (2, bytearray(b"broken"))], "doc_id long, raw binary")
    found, warned = markup.blocks(df, "doc_id", "raw", "DOCX")
    assert [(r.block_type, r.text) for r in found.orderBy("block_order").collect()] == [("TITLE", "T"), ("LIST_ITEM", "L"), ("TABLE", "| c |"), ("FOOTER", "F")]
    assert [(r.doc_id, r.code) for r in warned.collect()] == [(2, "BadZipFile")]
    sp = lambda y, t: f'<p:sp><a:off x="0" y="{y}"/><a:t>{t}</a:t></p:sp>'
    pptx = _zip(**{"ppt/presentation.xml": '<p:x xmlns:p="p"><p:sldSz cy="100"/></p:x>', "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{sp(5, "A")}{sp(20, "B")}{sp(90, "C")}</p:sld>'})
    assert [(b[2], b[4], b[5]) for b in markup.pptx_blocks(pptx)] == [("TITLE", "A", 1), ("PARAGRAPH", "B", 1), ("FOOTER", "C", 1)]
    hwpx = _zip(**{"Contents/section0.xml": '<s xmlns:h="h"><h:p><h:t>eins</h:t></h:p><h:tbl><h:tr><h:tc><h:p><h:t>z</h:t></h:p></h:tc></h:tr></h:tbl></s>'})
    assert [(b[2], b[4]) for b in markup.hwpx_blocks(hwpx)] == [("PARAGRAPH", "eins"), ("TABLE", "| z |")]


def test_pages_text(spark):
    pages = spark.createDataFrame([(1, 1, "Head\nbody one\n1"), (1, 2, "Head\nbody two\nHead\n2"), (2, 1, "Head\nx")], "doc_id int, page int, text string")
    assert [r.text for r in pages_text.without_boundaries(pages).orderBy("doc_id", "page").collect()] == ["body one\n1", "body two\n2", "Head\nx"]
    broken = "\n".join(["He", "llo", ",", "wor", "ld", "!", "so", "it", "goes"])
    assert spark.range(1).select(pages_text.mended(F.lit(broken)).alias("t")).first().t == "He llo, wor ld! so it goes"
    table = spark.createDataFrame([(1, 1, "intro\na  b\nc  d\n\nx  y  z")], "doc_id int, page int, text string")
    assert [(r.first_line, r.rows, r.columns, r.markdown) for r in pages_text.column_tables(table).collect()] == [(1, 2, 2, "| a | b |\n| c | d |")]
    words = spark.createDataFrame([(1, "b", 0.5, 50, 2, 40, 10), (1, "a", 0.9, 0, 0, 40, 10), (1, "c", None, 0, 30, 9, 9)], "doc_id int, text string, confidence double, x int, y int, width int, height int")
    lines = pages_text.word_lines(words)
    assert [(r.text, r.least_confidence) for r in lines.orderBy("line").collect()] == [("a b", 0.5), ("c", None)]
    assert pages_text.word_quality(lines).first().low_confidence
    images = spark.createDataFrame([(1, "i", 10)], "slide int, image_id string, bottom int")
    boxes = spark.createDataFrame([(1, 5, "above"), (1, 12, "near"), (1, 40, "far")], "slide int, top int, text string")
    assert pages_text.captions(images, boxes).first().caption == "near"


def test_a_deep_page_reads_the_ranges_it_lies_in(spark):
    rows = [(i, random.Random(i).choice([None, 1, 2, 2, 9])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    order = [F.col("v").desc_nulls_last(), F.asc("k")]
    index = paging.PageIndex(df, order, 16)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for offset in (0, 7, 123, 480, 499, 500, 10_000):
        assert [tuple(r) for r in index.page(paging.PageRequest(offset, 30)).collect()] == want[offset : offset + 30]
    deep = index.page(paging.PageRequest(400, 10))
    assert deep.inputFiles() and index.total == 500 and deep._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [_range") == 1
    assert paging.PageIndex(df.limit(0), order).page(paging.PageRequest(0, 5)).count() == 0


def test_words_belong_to_the_first_line_that_they_overlap(spark):
    schema = "doc_id int, i int, text string, confidence double, x int, y int, width int, height int"
    words = [(1, 0, "A", 90.0, 0, 0, 9, 20), (1, 1, "B", 0.8, 40, 15, 9, 20), (1, 2, "C", -1.0, 60, 16, 9, 6), (1, 3, "N", 0.3, None, None, None, None)]
    words += [(2, 0, "only", None, None, None, None, None), (2, 1, "box", 0.7, 5, 0, 9, 10), (2, 2, "low", 0.5, 0, 8, 9, 5), (2, 3, " ", 0.5, 0, 8, 9, 5)]
    lines = pages_text.word_lines(spark.createDataFrame(words, schema), order="i").orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.line, r.text) for r in lines] == [(1, 0, "A C"), (1, 1, "N B"), (2, 0, "only"), (2, 1, "low box")]
    assert [r.confidence for r in lines[:2]] == [0.9, 0.55] and lines[0].least_confidence == 0.9
    top_down = pages_text.word_lines(spark.createDataFrame(words, schema)).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.text) for r in top_down] == [(1, "A C"), (1, "N B"), (2, "low only box")]


def test_uneven_rows_are_no_table_but_a_warning(spark):
    pages = spark.createDataFrame([(1, 1, "Name  Score\nAlice  90"), (1, 2, "a  b\nc  d\ne  f  g"), (1, 3, "one  line\ntext"), (2, 1, "x  y\n\nz  w")], "doc_id int, page int, text string")
    assert [(r.page, r.markdown) for r in pages_text.column_tables(pages, separator=True).collect()] == [(1, "| Name | Score |\n| --- | --- |\n| Alice | 90 |")]
    assert [(r.doc_id, r.page, r.first_line, r.code) for r in pages_text.column_table_warnings(pages).collect()] == [(1, 2, 0, "TABLE_RECONSTRUCTION_PARTIAL")]


def test_captions_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    images = [(p, f"i{n}", rng.choice([None, *range(20)])) for p in range(6) for n in range(rng.randrange(6))]
    boxes = [(p, rng.choice([None, *range(20)]), rng.choice("abcd")) for p in range(5) for _ in range(rng.randrange(9))]
    got = pages_text.captions(spark.createDataFrame(images, "slide int, image_id string, bottom int"), spark.createDataFrame(boxes, "slide int, top int, text string"))
    want = {(p, i): min(((t - b, x) for q, t, x in boxes if q == p and t is not None and b is not None and t >= b), default=(0, None))[1] for p, i, b in images}
    assert {(r.slide, r.image_id): r.caption for r in got.collect()} == want and len(want) == len(images)


def test_a_bad_document_is_its_own_warning(spark):
    """Damaged archives, absurd spans and odd digits end no job and cost no other document."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:body>" + "".join(f"<w:p><w:r><w:t>text {i}</w:t></w:r></w:p>" for i in range(500)) + "</w:body></w:document>")
    docx = bytearray(out.getvalue())
    at = docx.index(b"word/document.xml") + 40
    docx[at : at + 30] = b"\xff" * 30
    pages = [
        (1, bytes(docx), "DOCX"), (2, b"<table><tr><td colspan='99999999999'>a</td><td>b</td></tr></table>", "HTML"),
        (3, "<table><tr><th colspan='2000000000' rowspan='\u00b2'>h</th></tr><tr><td>v</td></tr></table>".encode(), "HTML"), (4, b"<p>fine", "HTML"), (5, None, "HTML"), (6, b"<div>no block</div> at all", "HTML"), (7, b"x", "PDF"),
    ]
    df = spark.createDataFrame(pages, "doc_id int, content binary, format string").coalesce(1)
    found, warnings = markup.blocks(df, "doc_id", "content", F.col("format"))
    rows = {(r.doc_id, r.text): r for r in found.collect()}
    assert {k[0] for k in rows} == {2, 3, 4} and {(r.doc_id, r.code) for r in warnings.collect()} == {(1, "error"), (7, "UNSUPPORTED_FORMAT")}
    assert [(c.col, c.col_span) for c in rows[2, "| a | b |"].cells] == [(0, 1000), (1000, 1)] and rows[3, "| h |\n| v |"].cells[0].row_span == 1
    text = markup.table_text(found.where("block_type = 'TABLE'"), ["doc_id"]).where("doc_id = 3").first().vector_text
    assert text == "h: v"
    whole = markup.plain_text(markup.parsed(df, "doc_id", "content", F.col("format")), "doc_id").collect()
    assert {r.doc_id: r.text for r in whole}[6] == "no block at all"


def test_values_that_are_no_numbers(spark):
    row = spark.createDataFrame([("abc",), ("5",), (None,)], "v string")
    assert [r.v for r in row.where(filters.Range(1, 9).holds(F.col("v"))).collect()] == ["5"]
    used = tx.token_usage(F.create_map(F.lit("a"), F.col("v")), "a", "b")
    assert [r.n for r in row.select(used.alias("n")).collect()] == [0, 5, 0]


def test_the_fixed_plan_makes_each_text_once(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = chunking.fixed(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(text") == 1 or plan.count("\\r\\n?") == 1
    rng = random.Random(1)
    long = "".join(rng.choice("ab  \n") for _ in range(3000)) + " " * 60 + "end"
    made = chunking.fixed(spark.createDataFrame([(1, long)], "doc_id int, text string"), sizes=chunking.Sizes(7, 2)).orderBy("chunk_order").collect()
    text = long.strip(tx.LOW)
    cut = [(i, text[i : i + 7]) for i in range(0, len(text), 5) if i == 0 or len(text) - i > 2]
    kept = [(i, w.strip(tx.LOW), i + len(w)) for i, w in cut if w.strip(tx.LOW)]
    assert [(r.start_offset, r.content, r.end_offset) for r in made] == kept and [r.chunk_order for r in made] == list(range(len(kept)))
    assert made[-1].next_chunk_id is None and made[0].prev_chunk_id is None and made[5].next_chunk_id == made[6].chunk_id


def test_access_and_paging(spark):
    row = spark.range(1).select(access.permissions(F.lit(64)).alias("p"), access.actions(F.lit(16)).alias("a"), access.role_name(F.lit(" role_x ")).alias("r"), files.file_format(F.lit("TEXT/html; x"), F.lit("a.pdf")).alias("f")).first()
    assert row.p == ["READ", "UPLOAD", "WRITE"] and row.a == ["read", "write", "admin"] and row.r == "X" and row.f == "HTML"
    assert paging.PageRequest(-3, 0).clamped == (0, 50) and paging.PageRequest(1, 999).clamped == (1, 200) and paging.clamp_limit(None) == 20
    rows = spark.createDataFrame([("d", None, "read", ["A"])], "domain string, component string, action string, roles array<string>")
    users = spark.createDataFrame([("u", "A"), ("root", "ADMIN")], "user string, role string")
    assert {(r.user, r.action) for r in relational.allowed(rows, users).collect()} == {("u", "read"), ("root", "*")}


def test_statements(spark):
    catalog = StatementCatalog().add("a.b", "SELECT :x AS x").add("c", lambda p: "SELECT 1 AS y" + (" WHERE false" if p.get("none") else ""))
    assert catalog.run(spark, "a.b", x=3, unused=4).first().x == 3
    assert catalog.run(spark, "c", none=True).count() == 0
    for bad in ("", "SELECT 1; DROP TABLE t", "SELECT 1 -- x"):
        with pytest.raises(ValueError):
            catalog.add("bad", bad)
    with pytest.raises(KeyError):
        catalog.text("missing")


def test_table_statements(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, kind string").createOrReplaceTempView("things")
    catalog = StatementCatalog().add_table("t", "things", "id", by=("kind",))
    assert catalog.run(spark, "t.countAll").first().total == 3 and catalog.run(spark, "t.exists", id=9).first().found is False
    assert [r.id for r in catalog.run(spark, "t.search", kind="a").collect()] == [1, 3] and [r.id for r in catalog.page(spark, "t.findPage", 1, 1).collect()] == [2]
    assert catalog.run(spark, "t.findByKind", kind="b").count() == 1 and catalog.run(spark, "t.search").count() == 3


def test_ports(spark):
    from tessera.operators import indexing

    profiles = [indexing.Profile("p", "x", "m", 64), indexing.Profile("q", "x", "n", 8, ("TEXT", "OCR"))]
    assert indexing.resolve(profiles, provider="x", model="n", kind="OCR").name == "q"
    for bad in ({}, {"name": "p", "model": "m"}, {"name": "p", "kind": "OCR"}, {"name": "z"}):
        with pytest.raises(ValueError):
            indexing.resolve(profiles, **bad)

    def make():
        return lambda texts: [{"up": "UP", "blank": " "}[texts[0]]]

    long = spark.createDataFrame([("up" * 5,)], "text string")
    assert indexing.cleaned(long, make, most_chars=2).first().text == "UP" * 5
    rows = indexing.cleaned(spark.createDataFrame([("up",), ("blank",), ("fails",), (None,)], "text string"), make).collect()
    assert [(r.text, r.cleaned) for r in rows] == [("UP", True), ("blank", False), ("fails", False), (None, False)]
    made = indexing.index_documents(docs(spark, "a b", "a b", ""), indexing.hash_embedding)
    assert made.count() == 2 and len({tuple(r.embedding) for r in made.collect()}) == 1


def test_bounded_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny")
    (tmp_path / "big.txt").write_bytes(b"z" * 50)
    (tmp_path / "odd.log").write_bytes(b"ok \xff here")
    kept, rejected = files.read_files(spark, str(tmp_path), 10)
    assert {r.text for r in files.text_files(kept).collect()} == {"x\ny", "ok \ufffd here"} and [r.name for r in rejected.collect()] == ["big.txt"]


@pytest.mark.parametrize(
    ("kind", "name", "want"),
    [("text/html", "", "HTML"), ("", "a.HTM", "HTML"), ("text/csv", "", "TEXT"), ("application/xhtml+xml", "a.xhtml", "UNKNOWN"), ("", "a.md", "UNKNOWN"), ("", "a.gif", "UNKNOWN"), ("image/gif", "a.gif", "IMAGE"), ("", "a.tif", "UNKNOWN"),
     ("application/x-hwp", "a", "UNKNOWN"), ("", "a.hwp", "HWP"), ("", "a.hwpx", "HWPX"), ("application/pdf", "a.txt", "TEXT"), (None, None, "UNKNOWN")],
)
def test_file_formats(spark, kind, name, want):
    df = spark.createDataFrame([(kind, name)], "kind string, name string")
    assert df.select(files.file_format(F.col("kind"), F.col("name")).alias("f")).first().f == want


def test_images_and_tables_in_tables(spark):
    html = "<main><img><img alt=' Pic '><table><tr><td>a<table><tr><td>b</table><td><img alt=In></table><p>t</main>"
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    found, _ = markup.blocks(df, "doc_id", "html")
    assert [(r.block_type, r.path) for r in found.orderBy("block_order").collect()] == [("IMAGE_CAPTION", "img[0]"), ("TABLE", "table[1]"), ("TABLE", "table[2]"), ("IMAGE_CAPTION", "img[3]"), ("PARAGRAPH", "p[4]")]
    assert [(r.source_ref, r.alt) for r in markup.images(df, "doc_id", "html").collect()] == [("img[0]", ""), ("img[0]", "Pic"), ("img[3]", "In")]


def test_searches_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(200)] + [(500, None, 0), (501, [1.0, None, 1.0], 0), (502, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    full = [(i, v, c) for i, v, c in rows if v is not None and None not in v]
    for same, block in ((None, 1000), ("label", 3)):
        got = {}
        for r in retrieval.top_k_each(df.repartition(3), asked, 4, same=same, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = {}
        for q, v, c in full:
            if q % 20 == 0 and len(v) == 3:
                near = sorted((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), i) for i, w, d in full if len(w) == 3 and (not same or c == d))
                want[q] = [i for _, i in near[:4]]
        assert got == want
    assert retrieval.top_k_each(df, asked.limit(0), 4).count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(7, 2), (5, 4), (6, 0), (1, 0), (9, 7)])
def test_fixed_windows_of_any_overlap(spark, size, overlap):
    texts = ["", "é", "abcdefghij klm  nop\n\n    qrst\U0001f600uvw" * 3, "x" * size, "y" * (size + 1), " a" * 20]
    got = {}
    for r in chunking.fixed(docs(spark, *texts), sizes=chunking.Sizes(size, overlap)).orderBy("chunk_order").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_order, r.start_offset, r.end_offset, r.content))
    for i, t in enumerate(texts):
        t, want, at = t.strip(), [], 0
        while t:
            end = min(at + size, len(t))
            if part := t[at:end].strip():
                want.append((len(want), at, end, part))
            if end == len(t):
                break
            at = max(end - overlap, at + 1)
        assert got.get(f"doc-{i + 1}", []) == want


def test_fixed_windows_move_nothing(spark):
    plan = chunking.fixed(docs(spark, "a b c"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ancestry_reaches_every_root(spark):
    from tessera.operators import conversations

    rows = [(i, i - 1 if i else None) for i in range(150)] + [(200, 999), (201, 200), (300, 301), (301, 300), (302, 301), (400, 400)]
    got = {r.conv_id: (r.root, r.depth) for r in conversations.ancestry(spark.createDataFrame(rows, "conv_id long, parent_conv_id long")).collect()}
    want = {i: (0, i) for i in range(150)} | {200: (200, 0), 201: (200, 1)} | dict.fromkeys((300, 301, 302, 400), (None, None))
    assert got == want
    assert conversations.ancestry(spark.createDataFrame([], "conv_id long, parent_conv_id long")).count() == 0


def test_keywords_count_whole_texts(spark):
    from tessera.operators import indexing

    text = "early " * 700 + "late " * 900
    df = docs(spark, text)
    assert indexing.keywords(df).first().keywords == ["late", "early"]
    assert indexing.keywords(df, most_chars=3000).first().keywords == ["early"]


def test_siblings_of_single_chunks_are_not_made_distinct(spark):
    """Where hits and chunks are single, joins give distinct rows; repeated ones still come once."""
    rows = [("t", o, f"{o}-{n}", "child", None if n % 3 == 0 else "" if n == 4 else f"p{n // 4}", "s", None, None) for o in ("1", "2") for n in range(12)]
    schema = "object_type string, object_id string, chunk_id string, chunk_type string, parent_chunk_id string, section string, prev_chunk_id string, next_chunk_id string"

    def want(rows):
        mate = lambda a, b: a[:2] == b[:2] and (a[2] == b[2] or (a[4] and a[4] == b[4]))
        return sorted({(a[1] + a[2], a[1], b[2]) for a in rows for b in rows if mate(a, b)})

    for made, plain in ((rows, True), ([*rows, rows[1], ("t", "1", "1-1", "child", "p1", "s", None, None)], False)):
        chunks = spark.createDataFrame(made, schema)
        hits = chunks.select(F.concat("object_id", "chunk_id").alias("hit_id"), "object_type", "object_id", "chunk_id")
        got = context.siblings(hits, chunks, "parent_chunk_id")
        assert ("Aggregate" not in got._jdf.queryExecution().executedPlan().toString()) == plain
        assert sorted((r.hit_id, r.object_id, r.chunk_id) for r in got.collect()) == want(made)


def test_keywords_of_single_rows_are_not_moved(spark):
    """Terms of documents of one row stay where they are; rows of one id, and of none, are counted together."""
    from collections import Counter

    from tessera.operators import indexing

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Abc", "abd", "éèê", "zzz", "of", "Ünï", "\U00010400xy", "\uff41xy", "x1y"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    single = [*enumerate(texts), (900, None), (901, ""), (None, "one two two")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def want(rows):
        counts = {}
        for i, t in rows:
            counts.setdefault(i, Counter()).update(w for w in (t or "").lower().split() if len(w) > 2)
        return {i: sorted(c, key=lambda w: (-c[w], w))[:3] for i, c in counts.items() if c}

    made = indexing.keywords(frame(single), n=3)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.keywords for r in made.collect()} == want(single)
    several = [*single, (None, "two three"), *((i, texts[i + 1]) for i in range(0, 40, 2))]
    got = indexing.keywords(frame(several), n=3).collect()
    assert len(got) == len(want(several)) and {r.doc_id: r.keywords for r in got} == want(several)


def test_parsing_is_dealt_to_tasks_and_a_bad_document_is_its_own_warning(spark, monkeypatch):
    """One file is one split: without dealing, one task parses all documents."""
    from tessera.sources import markup

    monkeypatch.setitem(markup.PARSERS, "BAD", lambda raw: [(0, "b0", "PARAGRAPH", "p", {"no": "text"}, None, [])])
    rows = [(i, f"<p>{i}</p>", "HTML") for i in range(200)] + [(900, "x", "BAD"), (901, None, "HTML"), (902, "x", "NONE")]
    df = spark.createDataFrame(rows, "id int, raw string, fmt string").coalesce(1)
    made = markup.parsed(df, "id", "raw", F.col("fmt"))
    assert made.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.id: (r.block_type, r.text) for r in made.collect()}
    assert len(got) == 202 and got[7] == ("PARAGRAPH", "7") and got[900][0] == "WARNING" and got[902] == ("WARNING", "NONE")


def test_ancestry_broadcasts_nothing(spark):
    """What is broadcast goes through the driver, which then gets more with each round and size."""
    from tessera.operators import conversations

    made = []
    keep = conversations.written
    conversations.written = lambda df, name: made.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name)
    try:
        rows = spark.createDataFrame([(i, i - 1 if i % 9 else None) for i in range(100)], "conv_id long, parent_conv_id long")
        got = {r.conv_id: (r.root, r.depth) for r in conversations.ancestry(rows).collect()}
    finally:
        conversations.written = keep
    assert got == {i: (i // 9 * 9, i % 9) for i in range(100)}
    assert len(made) > 2 and not any("BroadcastHashJoin" in p for p in made)


def test_words_are_moved_once(spark):
    """Lines are put together where words were placed: a second exchange moved every word again."""
    rows = [(1, "b", 0.5, 50, 0, 9, 10), (1, " a ", None, 5, 1, 9, 10), (1, "low", 90.0, 0, 40, 9, 10), (1, "boxless", -1.0, None, None, None, None), (2, "x", -1.0, None, None, None, None)]
    words = spark.createDataFrame(rows, "doc_id int, text string, confidence double, x int, y int, width int, height int")
    made = pages_text.word_lines(words)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = sorted((tuple(r) for r in made.select("doc_id", "line", "text", "confidence", "least_confidence", "top").collect()), key=lambda r: r[:2])
    assert got == [(1, 0, "a b", 0.5, 0.5, 0), (1, 1, "low boxless", 0.9, 0.9, 40), (2, 0, "x", None, None, None)]


def test_lines_of_many_documents_are_folded_together(spark):
    """Against the rule word by word: chains of boxes, boxes without height, words without a box, repeated rows of one page."""
    import numpy as np

    rng = random.Random(5)

    def plain(words):
        lines = []
        for y, h in words:
            at = max(len(lines) - 1, 0)
            if y is not None and h is not None:
                meets = [n for n, (u, w) in enumerate(lines) if min(w, y + h) - max(u, y) > 0 and min(w, y + h) - max(u, y) >= min(w - u, h) // 2]
                at = meets[0] if meets else len(lines)
                if meets:
                    lines[at] = (min(lines[at][0], y), max(lines[at][1], y + h))
                else:
                    lines.append((y, y + h))
            elif not lines:
                lines.append((0, 0))
            yield at

    docs = [[(rng.choice([None, rng.randrange(high), rng.randrange(high), -3]), rng.choice([None, 0, -2, 5, 9, 20, 90])) for _ in range(rng.choice([1, 2, 7, 60, 300]))] for high in [10, 100, 1000] * 12]
    top, height = ([w[c] for d in docs for w in d] for c in (0, 1))
    boxed = np.array([a is not None and b is not None for a, b in zip(top, height, strict=True)])
    upper, lower = np.array([a or 0 for a in top]), np.array([(a or 0) + (b or 0) for a, b in zip(top, height, strict=True)])
    owner = np.repeat(np.arange(len(docs)), list(map(len, docs)))
    among, number = pages_text.lines_of(owner, upper, lower, boxed)
    want = [list(plain(d)) for d in docs]
    assert number.tolist() == [n for d in want for n in d]
    assert among.max() + 1 == sum(max(d) + 1 for d in want) == len(set(zip(owner.tolist(), number.tolist(), strict=True)))
    rows = [(i, n, f"w{n}", 0.5, n, y, 9, h) for i, d in enumerate(docs) for n, (y, h) in enumerate(d)]
    words = spark.createDataFrame(rows, "doc_id int, i int, text string, confidence double, x int, y int, width int, height int").repartition(3)
    got = {(r.doc_id, r.line): r.text for r in pages_text.word_lines(words, order="i").collect()}
    assert got == {(i, at): " ".join(f"w{n}" for n, x in enumerate(d) if x == at) for i, d in enumerate(want) for at in d}
    # parts of a page in several rows are one page, and no word of it is moved by itself
    parts = words.groupBy("doc_id", (F.col("i") % 2).alias("part")).agg(*[F.expr(f"transform(array_sort(collect_list(struct(i, {c} AS v))), x -> x.v)").alias(c) for c in ("i", *pages_text.WORD)])
    made = pages_text.page_lines(pages_text.dealt(parts.drop("part")), order="i")
    assert {(r.doc_id, r.line): r.text for r in made.collect()} == got


def test_a_long_page_is_one_run():
    import numpy as np
    import pyarrow as pa

    column = [1] * 3 + [2] * 40 + [None] * 5 + [3]
    batches = [pa.RecordBatch.from_pydict({"doc": pa.array(column[i : i + 4], pa.int64())}) for i in range(0, len(column), 4)]
    parts = list(pages_text.whole_runs(iter(batches), least=6))
    assert len(parts) > 1 and [x for p, _ in parts for x in p.column(0).to_pylist()] == column
    assert [n for _, ends in parts for n in np.diff(ends, prepend=0).tolist()] == [3, 40, 5, 1]
    assert all(len(p) == ends[-1] for p, ends in parts)


def test_ocr_pages_are_moved_as_texts(spark):
    """Words were moved one by one with their boxes: each row of that exchange was a word."""
    from tessera.plans import chunks, rules

    for made in (chunks.ocr_lines, rules.ocr_lines_overlapping):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = plan[plan.index("Exchange") :].splitlines()[1]
        assert plan.count("Exchange") == 1 and "said" in moved and "height" not in moved
