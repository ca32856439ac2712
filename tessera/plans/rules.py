"""Queries of single rules over tables made so that SQL can state their results: parsers, sections and packing, store
records, ports, names and clamps."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import access
from tessera.functions import text as tx
from tessera.operators import chunking, context, indexing, paging, relational
from tessera.plans.chunks import SOURCE, _fixed_sql, _normalised, word_pages
from tessera.plans.registry import query
from tessera.plans.search import CLEAN
from tessera.session import fresh_folder, scan
from tessera.sources import files, markup, pages_text, store
from tessera.sources.statements import StatementCatalog, acceptable

NONE = "CAST(NULL AS VARCHAR)"
TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _said(*parts: Column | str) -> Column:
    """Columns and literals put together as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Files and parsers


@query("SELECT * FROM (VALUES ('nation.parquet', 2559::BIGINT, 'UNKNOWN'), ('region.parquet', 1793::BIGINT, 'UNKNOWN')) t(name, bytes, format)")
def bounded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' own files of up to 2600 bytes, read as files."""
    kept, _ = files.read_files(spark, sf_dir, 2600)
    return kept.where(F.col("name").isin("nation.parquet", "region.parquet")).select("name", F.length("content").cast("long").alias("bytes"), "format")


@query(f"WITH d AS (SELECT doc_id, text || chr(65533) || '.' AS text FROM documents) SELECT doc_id, sha256({CLEAN}) AS clean_hash FROM d")
def text_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF2E")))
    return scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.content_hash(tx.clean_text(files.decoded(raw))).alias("clean_hash"))


@query("""SELECT c_custkey, ['PARAGRAPH', 'PARAGRAPH', 'TITLE', 'UNSUPPORTED_FORMAT'][c_custkey % 4 + 1] AS block_type,
  CASE WHEN c_custkey % 4 = 3 THEN 'UNKNOWN' ELSE c_name END AS text FROM customer""")
def parsed_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("c_custkey") % 4 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*x), kind)
    name = pick(F.lit("a.HTML"), F.lit("b.txt"), F.lit("c.htm"), F.lit("d.gif"))
    content = pick(_said("<p>", F.col("c_name"), "<p> "), _said("  ", F.col("c_name"), "\n"), _said("<h1>", F.col("c_name"), "</h1>"), F.col("c_name"))
    rows = scan(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", F.encode(content, "utf-8").alias("content"), files.file_format(F.lit(None).cast("string"), name).alias("format"))
    made, warned = markup.parsed(rows, "c_custkey", "content", F.col("format")), F.col("block_type") == "WARNING"
    kept = made.where(warned | ~F.col("block_type").isin(*markup.NO_BLOCKS))  # blocks and warnings of one pass
    return kept.select("c_custkey", F.when(warned, F.col("path")).otherwise(F.col("block_type")).alias("block_type"), "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    html = _said(
        "<body><nav><p>no</p></nav><main><h1 id='t", k, "'>", F.col("c_name"), "</h1><p>", segment, " <b>x</b></p><img src='s.png'><img alt='pic ", k, "'><ul><li>", segment,
        "</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>", k, "</td><td>", segment, "<img alt='in'></td></tr></table><p> </p><h2>end</h2></main><p>out</p></body>",
    )
    return scan(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(k.alias("page_id"), html.alias("html"))


HTML = """b AS (SELECT c_custkey AS page_id, unnest(range(0, 7)) AS i, c_name, c_mktsegment AS s FROM customer),
blocks AS (SELECT page_id, i, c_name, s, ['TITLE', 'PARAGRAPH', 'IMAGE_CAPTION', 'LIST_ITEM', 'TABLE', 'IMAGE_CAPTION', 'HEADING'][i + 1] AS block_type,
  ['h1#t' || page_id, 'p[1]', 'img[2]', 'li[3]', 'table[4]', 'img[5]', 'h2[6]'][i + 1] AS path,
  [c_name, s || ' x', 'pic ' || page_id, s, '| a | b |' || chr(10) || '| ' || page_id || ' | ' || s || ' |', 'in', 'end'][i + 1] AS text FROM b)"""


@query(f"WITH {HTML} SELECT page_id, CAST(i AS INTEGER) AS block_order, block_type, path, text FROM blocks")
def html_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = markup.blocks(_pages(spark, sf_dir), "page_id", "html")
    return found.select("page_id", "block_order", "block_type", "path", "text")


@query(f"""WITH {HTML}, n AS (
  SELECT page_id, 0 AS kind, i, block_type, text, path, CASE WHEN i IN (0, 6) THEN '' ELSE c_name END AS heading_path FROM blocks WHERE i <> 4
  UNION ALL SELECT page_id, 1, i, 'TABLE', 'a: ' || page_id || ' | b: ' || s, path, c_name FROM blocks WHERE i = 4
  UNION ALL SELECT page_id, 2, i, 'IMAGE_CAPTION', text, path, '' FROM blocks WHERE block_type = 'IMAGE_CAPTION')
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY kind, i) - 1 AS INTEGER) AS block_order, block_type, text, path AS source_ref, heading_path FROM n""")
def html_page_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(_pages(spark, sf_dir)).select("page_id", "block_order", "block_type", "text", "source_ref", "heading_path")


def _zipped(parts: dict[str, str]) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


@query("""SELECT r_regionkey AS doc_id, format, block_order, block_type, CASE WHEN block_type = 'TABLE' THEN '| ' || r_name || ' |' ELSE r_name || tail END AS text FROM region,
(VALUES ('DOCX', 0, 'TITLE', ''), ('DOCX', 1, 'LIST_ITEM', ' l'), ('DOCX', 2, 'TABLE', ''), ('DOCX', 3, 'FOOTER', ' f'), ('PPTX', 0, 'TITLE', ''), ('PPTX', 1, 'PARAGRAPH', ' p'), ('PPTX', 2, 'FOOTER', ' f'),
('HWPX', 0, 'PARAGRAPH', ''), ('HWPX', 1, 'TABLE', '')) t(format, block_order, block_type, tail)""")
def office_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each kind for each region, a dimension of fixed size."""
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    shape = lambda y, t: f'<p:sp><a:off x="0" y="{y}"/><a:t>{t}</a:t></p:sp>'
    rows = []
    for key, name in [(r.r_regionkey, r.r_name) for r in scan(spark, sf_dir, "region", "r_regionkey", "r_name").collect()]:
        body = f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr>{run(name)}</w:p><w:p><w:pPr><w:numPr/></w:pPr>{run(name + " l")}</w:p><w:tbl><w:tr><w:tc><w:p>{run(name)}</w:p></w:tc></w:tr></w:tbl>'
        docx = {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>', "word/footer1.xml": f'<w:ftr xmlns:w="w"><w:p>{run(name + " f")}</w:p></w:ftr>'}
        slide = f'<p:sld xmlns:p="p" xmlns:a="a">{shape(5, name)}{shape(20, name + " p")}{shape(90, name + " f")}</p:sld>'
        pptx = {"ppt/presentation.xml": '<p:x xmlns:p="p"><p:sldSz cy="100"/></p:x>', "ppt/slides/slide1.xml": slide}
        hwpx = {"Contents/section0.xml": f'<s xmlns:h="h"><h:p><h:t>{name}</h:t></h:p><h:tbl><h:tr><h:tc><h:p><h:t>{name}</h:t></h:p></h:tc></h:tr></h:tbl></s>'}
        rows += [(key, "DOCX", _zipped(docx)), (key, "PPTX", _zipped(pptx)), (key, "HWPX", _zipped(hwpx))]
    key_kind = scan(spark, sf_dir, "region", "r_regionkey").schema[0].dataType.simpleString()
    made = spark.createDataFrame(rows, f"doc_id {key_kind}, format string, raw binary").withColumn("id", _said(F.col("doc_id"), "/", F.col("format")))
    found, _ = markup.blocks(made, "id", "raw", F.col("format"))
    return found.select(F.substring_index("id", "/", 1).cast(key_kind).alias("doc_id"), F.substring_index("id", "/", -1).alias("format"), "block_order", "block_type", "text")


# Paged text


@query(rf"""WITH p AS (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS i FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS paragraph, sha256({TRIM.format('part')}) AS text_hash FROM u WHERE {TRIM.format('part')} <> ''""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan(spark, sf_dir, "documents", "doc_id", F.lit(1).alias("page"), "text")
    return pages_text.paragraphs(pages).select("doc_id", "paragraph", tx.content_hash(F.col("text")).alias("text_hash"))


@query("SELECT c_custkey AS doc_id, 1 AS first_line, 2 AS rows, 2 AS columns, '| a | ' || c_custkey || ' |' || chr(10) || '| b | ' || c_mktsegment || ' |' AS markdown FROM customer")
def page_column_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _said("intro\na  ", F.col("c_custkey"), "\nb   ", F.col("c_mktsegment"), "\n\nx  y  z")
    pages = scan(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))
    return pages_text.column_tables(pages).drop("page")


@query("""SELECT c_custkey AS doc_id, CAST(0 AS INTEGER) AS first_line, '| Name | Segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_mktsegment || ' |' AS markdown,
  CAST(NULL AS VARCHAR) AS code FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 3 END AS INTEGER), NULL, 'TABLE_RECONSTRUCTION_PARTIAL' FROM customer WHERE c_custkey % 3 <> 1""")
def page_tables_and_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer, with an even table, an uneven one, or one of each."""
    k = F.col("c_custkey")
    even, uneven = _said("Name  Segment\n", k, "   ", F.col("c_mktsegment")), _said("a  b\n", k, "  ", k, "  c")
    text = F.when(k % 3 == 1, even).when(k % 3 == 0, uneven).otherwise(F.concat(even, F.lit("\n\n"), uneven))
    pages = scan(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(k.alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))
    tables = pages_text.column_tables(pages, separator=True).select("doc_id", "first_line", "markdown", F.lit(None).cast("string").alias("code"))
    return tables.unionByName(pages_text.column_table_warnings(pages).select("doc_id", "first_line", F.lit(None).cast("string").alias("markdown"), "code"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w)
SELECT doc_id * 100000 + i // 200 AS page_id, CAST(i % 200 // 4 * 2 + i % 2 AS INTEGER) AS line, string_agg(word, ' ' ORDER BY CASE i % 4 WHEN 3 THEN -1 ELSE i END) AS text FROM p GROUP BY ALL""")
def ocr_lines_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words as boxes in order, four a group: the second is lower than the first, the third overlaps the first again,
    and the fourth, without a box, belongs to the latest line."""
    boxed = lambda i, own: (own * 50 + 10, i // 4 * 50 + (0, 15, 16)[own], 40, (20, 20, 6)[own])
    places = [(0.9, *(boxed(i, i % 4) if i % 4 < 3 else (None, None, 40, None))) for i in range(200)]
    return pages_text.page_lines(word_pages(spark, sf_dir, places), "page_id", order="i").select("page_id", "line", "text")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (SELECT string_agg(CAST((c_custkey + i) % 100 AS VARCHAR), ' ' ORDER BY i) FROM range(1, 10) r(i)) || ', end'
  ELSE (SELECT string_agg('line ' || i, chr(10) ORDER BY i) FROM range(1, 10) r(i)) END AS text FROM customer""")
def page_lines_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    short = _said(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: ((k + i) % 100).cast("string")), "\n"), "\n,\nend")
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: _said("line ", i)), "\n")
    return scan(spark, sf_dir, "customer", "c_custkey").select("c_custkey", pages_text.mended(F.when(k % 2 == 0, short).otherwise(long)).alias("text"))


BOXES = "SELECT o_custkey AS slide, CAST(floor(o_totalprice) AS INTEGER) % 100 AS top, o_orderpriority AS text FROM orders"


@query(f"""WITH i AS (SELECT o_custkey AS slide, CAST(o_orderkey AS VARCHAR) AS image_id, CAST(o_orderkey % 100 AS INTEGER) AS bottom FROM orders), b AS ({BOXES})
SELECT i.slide, i.image_id, arg_min(b.text, (b.top - i.bottom, b.text)) AS caption FROM i LEFT JOIN b ON i.slide = b.slide AND b.top >= i.bottom GROUP BY i.slide, i.image_id""")
def image_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    images = rows.select(F.col("o_custkey").alias("slide"), F.col("o_orderkey").cast("string").alias("image_id"), (F.col("o_orderkey") % 100).cast("int").alias("bottom"))
    boxes = rows.select(F.col("o_custkey").alias("slide"), (F.floor("o_totalprice").cast("int") % 100).alias("top"), F.col("o_orderpriority").alias("text"))
    return pages_text.captions(images, boxes).drop("bottom")


# Sections and packing: a customer is a document, its orders are its blocks

LINES = "l AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "orders", F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")))


@query(f"""WITH {LINES}, s AS (SELECT *, (n - 1) // 5 AS section, CASE WHEN n % 5 = 3 THEN 1 WHEN n % 5 IN (1, 2) THEN 0 ELSE 2 END AS part FROM l),
t AS (SELECT doc_id, section, part, string_agg('order ' || o_orderkey, chr(10) || chr(10) ORDER BY n) AS content, CASE WHEN count(*) = 1 AND max(part) = 1 AND min(part) = 1 THEN 'table' ELSE 'child' END AS chunk_type,
  round(avg(CASE WHEN n % 2 = 0 THEN o_totalprice END), 4) AS confidence, string_agg('b' || n, ',' ORDER BY n) AS block_ids, min(n) AS first FROM s GROUP BY doc_id, section, part),
r AS (SELECT doc_id, section, part, string_agg(o_orderpriority, ',' ORDER BY f) AS source_refs FROM (SELECT doc_id, section, part, o_orderpriority, min(n) AS f FROM s GROUP BY ALL) GROUP BY ALL),
p AS (SELECT doc_id, section, 'Part ' || section || chr(10) || chr(10) || string_agg('order ' || o_orderkey, chr(10) || chr(10) ORDER BY n) AS parent_content FROM s GROUP BY doc_id, section),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_order FROM t)
SELECT doc_id, CAST(chunk_order AS INTEGER) AS chunk_order, 'Part ' || section AS section, content, chunk_type, confidence, block_ids, source_refs, parent_content,
  doc_id || '-parent-' || section * 10 AS parent_chunk_id, CASE WHEN lag(section) OVER w = section THEN doc_id || '-' || (chunk_order - 1) END AS prev_chunk_id,
  CASE WHEN lead(section) OVER w = section THEN doc_id || '-' || (chunk_order + 1) END AS next_chunk_id
FROM k JOIN r USING (doc_id, section, part) JOIN p USING (doc_id, section) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_order)""")
def structured_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of five orders behind a heading; the third of each is a table."""
    lines, none = _lines(spark, sf_dir), F.lit(None).cast("string")
    section = F.floor((F.col("n") - 1) / 5)
    body = lines.select(
        "doc_id", (section * 10 + F.col("n") % 5 + F.when(F.col("n") % 5 == 0, 5).otherwise(0)).cast("int").alias("block_order"), _said("b", F.col("n")).alias("block_id"), F.when(F.col("n") % 5 == 3, "TABLE").otherwise("PARAGRAPH").alias("block_type"),
        _said("order ", F.col("o_orderkey")).alias("text"), F.col("o_orderpriority").alias("source_ref"), F.when(F.col("n") % 2 == 0, F.col("o_totalprice")).alias("confidence"),
    )
    heads = lines.where("n % 5 = 1").select("doc_id", (section * 10).cast("int").alias("block_order"), _said("h", section).alias("block_id"), F.lit("HEADING").alias("block_type"), _said("Part ", section).alias("text"), none.alias("source_ref"), F.lit(None).cast("double").alias("confidence"))
    made = chunking.structured(markup.carried_headings(body.unionByName(heads), "doc_id"))
    return made.select(
        "doc_id", "chunk_order", "section", "content", "chunk_type", F.round("confidence", 4).alias("confidence"), F.array_join("block_ids", ",").alias("block_ids"), F.array_join("source_refs", ",").alias("source_refs"),
        "parent_content", "parent_chunk_id", "prev_chunk_id", "next_chunk_id",
    )


@query(f"""WITH {LINES}, c AS (SELECT doc_id, max(n) AS m, unnest(range(0, max(n))) AS j FROM l GROUP BY doc_id), k AS (SELECT * FROM c WHERE j = 0 OR 2 * j + 2 <= m)
SELECT k.doc_id, CAST(j AS INTEGER) AS chunk_order, string_agg(lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), chr(10) || chr(10) ORDER BY n) AS content FROM k JOIN l ON l.doc_id = k.doc_id AND n BETWEEN 2 * j + 1 AND 2 * j + 3 GROUP BY k.doc_id, j""")
def structured_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ten characters, three to a chunk, of which the last is the next one's first."""
    none = F.lit(None).cast("string")
    blocks = _lines(spark, sf_dir).select("doc_id", F.col("n").alias("block_order"), _said("b", F.col("n")).alias("block_id"), F.lit("PARAGRAPH").alias("block_type"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("text"), none.alias("heading_path"), none.alias("source_ref"), F.lit(None).cast("double").alias("confidence"))
    return chunking.structured(blocks, sizes=chunking.Sizes(34, 10)).select("doc_id", "chunk_order", "content")


def _listed(width: int, gap: str) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.col("c_custkey") % 40 + 1), lambda i: F.lpad(i.cast("string"), width, "0")), gap)


PARTS = "c AS (SELECT c_custkey AS doc_id, c_custkey % 40 + 1 AS m, unnest(range(0, c_custkey % 40 + 1)) AS j FROM customer)"


@query(f"""WITH {PARTS}, k AS (SELECT * FROM c WHERE j = 0 OR 4 * j + 2 <= m)
SELECT doc_id, CAST(j AS INTEGER) AS chunk_order, CAST(24 * j AS INTEGER) AS start_offset, (SELECT string_agg(lpad(CAST(i AS VARCHAR), 5, '0'), ' ' ORDER BY i) FROM range(4 * j + 1, least(4 * j + 5, m) + 1) r(i)) AS content FROM k""")
def chunk_recursive_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five characters, five to a chunk, of which the last is the next one's first."""
    docs = scan(spark, sf_dir, "customer", F.col("c_custkey").alias("doc_id"), _listed(5, " ").alias("text"))
    return chunking.recursive(docs, sizes=chunking.Sizes(29, 5)).select("doc_id", "chunk_order", "start_offset", "content")


@query(f"""WITH {PARTS}, k AS (SELECT *, lpad(CAST(2 * j + 2 AS VARCHAR), 10, '0') AS a, lpad(CAST(2 * j + 3 AS VARCHAR), 10, '0') AS b FROM c WHERE j = 0 OR 2 * j + 2 <= m)
SELECT doc_id, CAST(j AS INTEGER) AS chunk_order, CASE WHEN j = 0 THEN '0000000001' || CASE WHEN m >= 2 THEN chr(10) || chr(10) || a ELSE '' END ELSE right(lpad(CAST(2 * j + 1 AS VARCHAR), 10, '0'), 4) || a END
  || CASE WHEN m >= 2 * j + 3 THEN chr(10) || chr(10) || b ELSE '' END AS content FROM k""")
def chunk_legacy_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of ten characters: three fill the first chunk, two the others, behind the last one's tail."""
    docs = scan(spark, sf_dir, "customer", F.col("c_custkey").alias("doc_id"), _listed(10, "\n\n").alias("text"))
    return chunking.overlapping(docs, sizes=chunking.Sizes(34, 4)).select("doc_id", "chunk_order", "content")


@query(f"WITH {_fixed_sql(800, 100)} SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM k GROUP BY doc_id")
def chunk_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's fixed windows; sizes that aren't sensible become the defaults."""
    made = chunking.chunk(scan(spark, sf_dir, "documents", "doc_id", "text"), "fixed-size", sizes=chunking.Sizes(0, -1))
    return made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query(f"SELECT doc_id, CAST(CASE WHEN {TRIM.format('text')} = '' THEN 0 ELSE length(text) END AS INTEGER) AS chars, CAST(ceil(length(regexp_replace({SOURCE}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) / 4) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def size_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", tx.size_in(F.col("text"), "character").alias("chars"), tx.size_in(F.col("text"), "token").alias("tokens"))


# Context of hits: an order is a chunk, and a hit, of its customer

CHUNKS = f"""{LINES}, k AS (SELECT doc_id, doc_id || '-' || n AS chunk_id, n, CASE WHEN n % 7 = 0 THEN 'table' ELSE 'child' END AS chunk_type,
  CASE WHEN n % 3 > 0 THEN doc_id || '-p' || n // 6 END AS parent_chunk_id, CASE WHEN n % 2 = 0 THEN o_orderpriority ELSE '' END AS section FROM l)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, doc = F.col("n"), F.col("doc_id").cast("string")
    w = Window.partitionBy("object_id").orderBy("n")
    made = _lines(spark, sf_dir).select(
        F.lit("t").alias("object_type"), doc.alias("object_id"), _said(doc, "-", n).alias("chunk_id"), "n", F.when(n % 7 == 0, "table").otherwise("child").alias("chunk_type"),
        F.when(n % 3 > 0, _said(doc, "-p", F.floor(n / 6))).alias("parent_chunk_id"), F.when(n % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("section"),
    )
    return made.withColumns({"prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})


def _hits(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("hit_id"), "object_type", "object_id", "chunk_id")


@query(f"""WITH {CHUNKS} SELECT h.chunk_id AS hit_id, c.chunk_id FROM k h JOIN k c ON h.doc_id = c.doc_id AND (h.chunk_id = c.chunk_id OR h.parent_chunk_id = c.parent_chunk_id)""")
def sibling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return context.siblings(_hits(chunks), chunks, "parent_chunk_id").select("hit_id", "chunk_id")


@query(f"""WITH {CHUNKS}, h AS (SELECT *, CASE WHEN chunk_type = 'table' THEN 0 WHEN parent_chunk_id IS NOT NULL THEN 1 WHEN section <> '' THEN 2 ELSE 3 END AS way FROM k)
SELECT h.chunk_id AS hit_id, c.chunk_id FROM h JOIN k c ON h.doc_id = c.doc_id AND (h.chunk_id = c.chunk_id OR way = 1 AND h.parent_chunk_id = c.parent_chunk_id OR way = 2 AND h.section = c.section OR way = 3 AND abs(h.n - c.n) = 1)""")
def expanded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return context.expanded(_hits(chunks), chunks).select("hit_id", "chunk_id")


@query(f"""WITH {CHUNKS} SELECT doc_id, string_agg('[' || n || '] docId=' || chunk_id || ' score=' || printf('%.3f', 1.0 / n) || chr(10) || section || chr(10) || chr(10), '' ORDER BY n) AS context FROM k WHERE n <= 8 GROUP BY doc_id""")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _chunks(spark, sf_dir).select(F.col("object_id").cast("long").alias("of"), F.col("chunk_id").alias("doc_id"), (1 / F.col("n")).alias("score"), F.col("section").alias("content"), F.col("n").alias("at"))
    return context.context_text(context.packed(hits, "of", [F.asc("at")]), "of").withColumnRenamed("of", "doc_id")


# Stores and ports


@query("""WITH n AS (SELECT doc_id AS chunk_index, unnest([0, 1, 2]) AS version FROM documents WHERE doc_id % 3 = 0)
SELECT chunk_index, CASE WHEN chunk_index % 3 = 0 THEN 2 ELSE -1 END AS version FROM (SELECT doc_id AS chunk_index FROM documents WHERE doc_id % 5 <> 0 UNION SELECT chunk_index FROM n)""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", F.lit("t").alias("object_type"), F.lit("1").alias("object_id"), F.col("doc_id").alias("chunk_index"))
    change = docs.where("chunk_index % 3 = 0").withColumn("version", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return store.upsert(docs.where("chunk_index % 5 <> 0").withColumn("version", F.lit(-1)), change, order=F.col("version")).select("chunk_index", "version")


@query("""SELECT count(*) AS affected, CAST(sum(version) AS BIGINT) AS versions FROM (SELECT DISTINCT doc_id, 0 AS version FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 = 0)""")
def insert_ignore_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", F.lit("t").alias("object_type"), F.lit("1").alias("object_id"), F.col("doc_id").alias("chunk_index"))
    change = docs.where("chunk_index % 3 = 0").withColumn("version", F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))))
    added = store.insert_missing(docs.where("chunk_index % 5 <> 0").withColumn("version", F.lit(-1)), change, order=F.col("version"))
    return added.agg(F.count("*").alias("affected"), F.sum("version").alias("versions"))


@query("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'T' || label ELSE 'DEFAULT' END AS object_type, CASE WHEN vec_id % 3 = 0 THEN 'o' || vec_id ELSE 'd' || vec_id END AS object_id,
  CAST(CASE vec_id % 4 WHEN 0 THEN vec_id WHEN 1 THEN vec_id + 1 ELSE 0 END AS INTEGER) AS chunk_index, CASE WHEN vec_id % 5 = 0 THEN 'own' ELSE 'd' || vec_id END AS document_id,
  CAST(CAST(embedding[1]::DOUBLE + 0.1 AS FLOAT) AS DOUBLE) AS first_number, CAST(len(embedding) AS INTEGER) AS embedding_dimension, ['TABLE', 'IMAGE_CAPTION', 'OCR', 'TEXT'][vec_id % 4 + 1] AS input_type FROM embeddings""")
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, label, none = F.col("vec_id"), F.col("label"), F.lit(None).cast("string")
    said = {
        "objectType": F.when(v % 2 == 0, _said("T", label)),
        "objectId": F.when(v % 3 == 0, _said("o", v)).when(v % 3 == 1, " "),
        "chunkOrder": F.when(v % 4 == 0, v.cast("string")).when(v % 4 == 2, "x"),
        "chunkIndex": F.when(v % 4 < 3, (v + 1).cast("string")).otherwise(none),
        "documentId": F.when(v % 5 == 0, "own"),
    }
    metadata = F.map_filter(F.create_map(*[x for k, c in said.items() for x in (F.lit(k), c)]), lambda _, x: x.isNotNull())
    chunks = scan(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").select("vec_id", _said("d", v).alias("document_id"), metadata.alias("metadata"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.1).alias("embedding"))
    rows = store.record(chunks)
    kind = F.element_at(F.array(*map(F.lit, ("table", "image-caption", "ocr", "child"))), (v % 4 + 1).cast("int"))
    return rows.select("vec_id", "object_type", "object_id", "chunk_index", F.col("metadata")["documentId"].alias("document_id"), F.get("embedding", F.lit(0)).cast("double").alias("first_number"), "embedding_dimension", indexing.input_type(kind).alias("input_type"))


@query(f"""WITH cleaned AS (SELECT doc_id, {CLEAN} AS text FROM documents), {_fixed_sql(800, 100).replace('FROM documents', 'FROM cleaned')}
SELECT CAST(doc_id AS VARCHAR) AS object_id, chunk_order AS chunk_index, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id, sha256(content) AS content_hash,
  CAST(length(content) AS INTEGER) AS char_count, 64 AS dimension, true AS same_vector FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_order)""")
def index_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index pipeline with fixed windows; equal contents have equal vectors."""
    rows = indexing.index_documents(scan(spark, sf_dir, "documents", "doc_id", "text"), indexing.hash_embedding, "fixed-size")
    same = F.min("embedding").over(Window.partitionBy("content_hash")) == F.col("embedding")
    return rows.select("object_id", "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id", "content_hash", "char_count", F.size("embedding").alias("dimension"), same.alias("same_vector"))


@query("""SELECT c_custkey, CASE WHEN c_name LIKE '%7%' OR c_name LIKE '%9%' THEN c_name ELSE upper(c_name) END AS text, NOT (c_name LIKE '%7%' OR c_name LIKE '%9%') AS cleaned FROM customer""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaner that fails for some texts and has no answer for others."""

    def make():
        return lambda texts: [{True: " ", False: t.upper()}["9" in t] if "7" not in t else 1 // 0 for t in texts]

    return indexing.cleaned(scan(spark, sf_dir, "customer", "c_custkey", F.col("c_name").alias("text")), make)


@query("SELECT 'objects' AS source, CAST(n_nationkey AS VARCHAR) AS document_id, n_name AS text FROM nation UNION ALL SELECT 'raw', '1', 'given' UNION ALL SELECT 'any', 'r' || r_regionkey, r_name FROM region")
def job_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests, each run by the first executor that supports its source."""
    nations = scan(spark, sf_dir, "nation", F.col("n_nationkey").cast("string").alias("document_id"), F.col("n_name").alias("text"))
    regions = scan(spark, sf_dir, "region", _said("r", F.col("r_regionkey")).alias("document_id"), F.col("r_name").alias("text"))
    executors = [
        indexing.SourceExecutor(lambda r: r["source_type"] == "raw", lambda r: spark.createDataFrame([("1", r["text"])], "document_id string, text string")),
        indexing.SourceExecutor(lambda r: r["source_type"] == "objects", lambda r: nations),
        indexing.SourceExecutor(lambda r: True, lambda r: regions),
    ]
    out = None
    for request in ({"source_type": "raw", "text": "given"}, {"source_type": "objects"}, {"source_type": "any"}):
        rows = indexing.run_job(request, executors).select(F.lit(request["source_type"]).alias("source"), "document_id", "text")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT * FROM (VALUES ('by name', 'small'), ('by model', 'wide'), ('other input', 'none'), ('both', 'none')) t(asked, profile)")
def embedding_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = [indexing.Profile("small", "p", "m", 64), indexing.Profile("wide", "p", "n", 256, ("TEXT", "OCR"))]
    asked = {"by name": {"name": "small"}, "by model": {"provider": "p", "model": "n", "kind": "OCR"}, "other input": {"name": "small", "kind": "OCR"}, "both": {"name": "small", "model": "m"}}

    def named(request: dict) -> str:
        try:
            return indexing.resolve(profiles, **request).name
        except ValueError:
            return "none"

    return spark.createDataFrame([(k, named(r)) for k, r in asked.items()], "asked string, profile string")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'P' || c_nationkey WHEN 1 THEN 'P' || c_nationkey
  WHEN 2 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'P' || c_nationkey END WHEN 3 THEN (SELECT 'P' || min(n_nationkey) FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation n WHERE n.n_nationkey = c_nationkey)) END AS profile FROM customer""")
def profiles_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer asks for a profile of its nation: by name, by provider and model, for another input, by the provider
    alone, by name and model at once (no answer), or for none that there is."""
    n = F.col("n_nationkey")
    inputs = F.when(n % 2 == 0, F.array(F.lit("TEXT"), F.lit("OCR"))).otherwise(F.array(F.lit("TEXT")))
    profiles = scan(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(n.alias("position"), _said("P", n).alias("profile"), _said("R", F.col("n_regionkey")).alias("provider"), _said("M", n).alias("model"), inputs.alias("inputs"))
    nations = scan(spark, sf_dir, "nation", F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    k, own = F.col("c_custkey") % 6, F.col("c_nationkey")
    asked = scan(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(nations, "c_nationkey").select(
        "c_custkey", F.when(k.isin(0, 2, 4), _said("P", own)).when(k == 5, "none").alias("name"), F.when(k.isin(1, 3), _said("R", F.col("n_regionkey"))).alias("provider"),
        F.when(k.isin(1, 4), _said("M", own)).alias("model"), F.when(k == 2, "OCR").alias("kind"),
    )
    return indexing.resolved(asked, profiles, "c_custkey")


@query("SELECT c_custkey, c_custkey % 5 IN (0, 1) AS accepted FROM customer")
def statements_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each customer: sound ones, blank ones, second statements and comments."""
    k, name = F.col("c_custkey"), F.col("c_name")
    said = F.element_at(F.array(_said("SELECT ", k), _said(" SELECT '", name, "'\n"), F.lit(" \n "), _said("SELECT ", k, "; DROP TABLE t"), _said("SELECT ", k, " -- ", name)), (k % 5 + 1).cast("int"))
    return scan(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", acceptable(said).alias("accepted"))


@query("""WITH f AS (SELECT c_nationkey, sum(length(c_name) + 1)::BIGINT AS bytes FROM customer GROUP BY c_nationkey), m AS (SELECT avg(bytes) AS most FROM f)
SELECT c_nationkey, bytes, CASE WHEN bytes <= floor(most) THEN 'TEXT' ELSE 'TOO_LARGE' END AS format FROM f, m""")
def files_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each nation's customers, of which those above the mean size are rejected unread."""
    lines = scan(spark, sf_dir, "customer", "c_nationkey", F.col("c_name").alias("value"))
    folder = fresh_folder(spark, "files")
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey").write.partitionBy("c_nationkey").text(folder)
    sizes = lines.groupBy("c_nationkey").agg(F.sum(F.length("value") + 1).alias("n"))
    most = sizes.agg(F.floor(F.avg("n")).alias("most")).first().most or 0
    kept, rejected = files.read_files(spark, folder, int(most))
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast(lines.schema["c_nationkey"].dataType).alias("c_nationkey")
    read = kept.select(nation, F.length("content").cast("long").alias("bytes"), "format")
    return read.unionByName(rejected.select(nation, F.col("length").cast("long").alias("bytes"), F.col("code").alias("format")))


# Names, answers and clamps


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'find ' || c_custkey END AS expanded_query, CASE WHEN c_custkey % 2 = 0 THEN 'q' END AS original_query,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ',y' ELSE 'u,v w,' || c_mktsegment END AS keywords FROM customer""")
def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    answer = F.when(k % 2 == 0, _said('```json\n{"expanded_query": " find  ', k, ' ", "original_query": "q", "keywords": ["', segment, '", "', F.lower(segment), '", " y "]}\n```')).otherwise(_said("u; v  w,U\n", segment))
    got = tx.rewritten_query(answer)
    return scan(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select("c_custkey", got["expanded_query"].alias("expanded_query"), got["original_query"].alias("original_query"), F.array_join(got["keywords"], ",").alias("keywords"))


@query(f"""WITH p AS (SELECT r_regionkey, lower(r_name) AS domain, unnest(['read', 'write']) AS action FROM region),
g AS (SELECT n_nationkey, 'N' || n_nationkey AS who, n_regionkey FROM nation)
SELECT who, domain, {NONE} AS component, action FROM g JOIN p ON n_regionkey = r_regionkey WHERE who <> 'N0' AND (action = 'read' OR r_regionkey % 2 = 0 OR n_nationkey % 2 = 0) UNION ALL SELECT 'N0', '*', NULL, '*'""")
def policy_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations hold a role of their region, even ones another too; regions of even keys have no roles for writing and so
    take those for reading; nation 0 is an administrator."""
    r = F.col("r_regionkey")
    rules = scan(spark, sf_dir, "region", "r_regionkey", "r_name").select(
        F.lower("r_name").alias("domain"), F.lit(None).cast("string").alias("component"), F.explode(F.array(
            F.struct(access.action_name(F.lit("View")).alias("action"), F.array(_said("R", r)).alias("roles")),
            F.struct(access.action_name(F.lit("manage")).alias("action"), F.when(r % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(_said("W", r))).alias("roles")),
        )).alias("a"),
    ).select("domain", "component", "a.*")
    n = scan(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    own = F.when(F.col("n_nationkey") == 0, F.array(F.lit("ADMIN"))).when(F.col("n_nationkey") % 2 == 0, F.array(_said("R", F.col("n_regionkey")), _said("W", F.col("n_regionkey")))).otherwise(F.array(_said("R", F.col("n_regionkey"))))
    return relational.allowed(relational.with_fallback(rules), n.select(_said("N", F.col("n_nationkey")).alias("user"), F.explode(own).alias("role"))).withColumnRenamed("user", "who")


@query("SELECT DISTINCT 'n' || n_regionkey AS child FROM nation")
def property_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.array(_said("app.mail.n", F.col("n_regionkey"), ".k", F.col("n_nationkey")), _said("app.mailbox.", F.col("n_nationkey")), F.lit("app.mail")))
    return scan(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(keys.alias("key")).select(tx.child_names(F.col("key"), "app.mail").alias("child")).where("child is not null").distinct()


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 ELSE 0 END AS INTEGER) AS used FROM events")
def token_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    usage = F.map_filter(F.create_map(F.lit("promptTokens"), F.when(e % 3 == 0, e.cast("string")).when(e % 3 == 2, "-4"), F.lit("prompt_tokens"), (e + 1).cast("string")), lambda _, v: v.isNotNull())
    return scan(spark, sf_dir, "events", "event_id").select("event_id", tx.token_usage(usage, "promptTokens", "prompt_tokens").alias("used"))


@query("(SELECT o_orderkey, 'page' AS asked FROM orders ORDER BY o_orderkey LIMIT 200) UNION ALL (SELECT o_orderkey, 'list' FROM orders ORDER BY o_orderkey DESC LIMIT 20)")
def clamped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = scan(spark, sf_dir, "orders", "o_orderkey")
    first = paging.page(keys, [F.asc("o_orderkey")], paging.PageRequest(-5, 100_000)).withColumn("asked", F.lit("page"))
    return first.unionByName(keys.orderBy(F.desc("o_orderkey")).limit(paging.clamp_limit(None)).withColumn("asked", F.lit("list")))


@query("SELECT * FROM (VALUES ('SELECT 1', true), ('', false), ('SELECT 1; DROP TABLE t', false), ('SELECT 1 -- all', false), ('SELECT /* x */ 1', false)) t(statement, accepted)")
def statement_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    def accepted(sql: str) -> bool:
        try:
            StatementCatalog().add("a", sql)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(s, accepted(s)) for s in ("SELECT 1", "", "SELECT 1; DROP TABLE t", "SELECT 1 -- all", "SELECT /* x */ 1")], "statement string, accepted boolean")
