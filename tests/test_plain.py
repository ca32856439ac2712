"""Queries that SQL can't state, held against plain versions over all rows of the smallest tables."""

import re

from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.plans import QUERIES
from tessera.plans.chunks import _page_blocks
from tessera.session import scan

SF = "/root/testdata/sf0.001"
LOW = "".join(map(chr, range(33)))


def sources(spark):
    """Documents as chunkers read them."""
    rows = scan(spark, SF, "documents", "doc_id", "text").collect()
    return {r.doc_id: re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", r.text or "").strip(LOW)) for r in rows}


def split(text, size):
    """The text, or its parts by the first pattern that gives several, each split further; else windows."""
    if len(text) <= size:
        return [text]
    for pattern in (r"\n\s*\n", r"\n", r"(?<=[.!?。！？])\s+", r"[ \t\n\x0b\f\r]+"):
        parts = [p.strip(LOW) for p in re.split(pattern, text)]
        parts = [p for p in parts if p]
        if len(parts) > 1:
            return [x for p in parts for x in split(p, size)]
    return [text[i : i + size].strip(LOW) for i in range(0, len(text), size)]


def recursive(text, size, overlap):
    out, held = [], ""
    for part in split(text, size):
        if not part:
            continue
        if not held:
            held = part
        elif len(held) + 1 + len(part) <= size:
            held += " " + part
        else:
            out.append(held.strip(LOW))
            tail = out[-1][-overlap:] + " " + part
            held = tail if len(tail) <= size else part
    return out + ([held.strip(LOW)] if held else [])


def test_recursive_chunks(spark):
    got = {}
    for r in chunking.recursive(scan(spark, SF, "documents", "doc_id", "text")).orderBy("doc_id", "chunk_order").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {k: recursive(t, 800, 100) for k, t in sources(spark).items() if t}
    shown = QUERIES["chunk_recursive"](spark, SF).collect()
    assert len(shown) == sum(map(len, got.values()))
    ids = {r.chunk_id for r in shown}
    assert all((r.prev_chunk_id is None) == (r.chunk_order == 0) and (r.prev_chunk_id is None or r.prev_chunk_id in ids) for r in shown)
    assert all((r.next_chunk_id is None) == (r.chunk_order == len(got[r.doc_id]) - 1) for r in shown)


def legacy(text, size, overlap):
    """One character at a time: a paragraph goes behind a blank line if it fits as a whole, else into a new chunk."""
    out, held = [], ""
    for paragraph in re.split(r"\n\s*\n", text):
        if not paragraph:
            continue
        joined = held + "\n\n" + paragraph if held else paragraph
        if len(joined) <= size:
            held = joined
            continue
        if held:
            out.append(held)
            held = held[-overlap:] if overlap else ""
        for c in paragraph:
            if len(held) == size:
                out.append(held)
                held = held[-overlap:] if overlap else ""
            held += c
    return [c.strip(LOW) for c in [*out, *([held] if held else [])]]


def test_legacy_chunks(spark):
    for size, overlap in ((500, 50), (120, 0)):
        got = {}
        for r in chunking.overlapping(scan(spark, SF, "documents", "doc_id", "text"), sizes=chunking.Sizes(size, overlap)).orderBy("doc_id", "chunk_order").collect():
            got.setdefault(r.doc_id, []).append(r.content)
        assert got == {k: legacy(t, size, overlap) for k, t in sources(spark).items() if t}


def structured(blocks, size, overlap):
    """Contents of a document's chunks: sections begin at headings, a heading before another heading is dropped."""
    sections = []
    for b in blocks:
        if b.block_type in ("TITLE", "HEADING"):
            if sections and not sections[-1]:
                sections.pop()
            sections.append([])
        else:
            if not sections:
                sections.append([])
            sections[-1].append(b)
    out = []
    for section in sections:
        held = []
        joined = lambda x: "\n\n".join(b.text for b in x if b.text and b.text.strip(LOW))
        for b in section:
            if b.block_type in ("TABLE", "IMAGE", "IMAGE_CAPTION", "OCR_TEXT"):
                out += [held, [b]] if held else [[b]]
                held = []
            elif held and len(joined([*held, b])) > size:
                out.append(held)
                tail = []
                for x in reversed(held):
                    if sum(len(y.text) for y in [x, *tail]) > overlap:
                        break
                    tail.insert(0, x)
                held = [*tail, b]
            else:
                held = [*held, b]
        out += [held] if held else []
    return [joined(x) for x in out]


def test_structured_chunks(spark):
    for size, overlap in ((800, 100), (120, 40)):
        blocks = _page_blocks(spark, SF)
        own = {}
        for r in blocks.orderBy("doc_id", "block_order").collect():
            own.setdefault(r.doc_id, []).append(r)
        got = {}
        for r in chunking.structured(blocks, sizes=chunking.Sizes(size, overlap)).orderBy("doc_id", "chunk_order").collect():
            got.setdefault(r.doc_id, []).append(r.content)
        assert got == {k: w for k, b in own.items() if (w := structured(b, size, overlap))}


def test_page_texts(spark):
    """Blocks of all pages have the texts, in order, that stand between a page's tags; what is never closed ends where
    the next block begins."""
    import html as entities

    ends = r"(?=</\1\s*>|<(?:p|h[1-6]|ul|ol|table|div|section)\b|\Z)"
    pages = {r.page_id: r.html for r in scan(spark, SF, "pages", "page_id", "html").collect()}
    found = {}
    for r in QUERIES["html_blocks"](spark, SF).where("block_type in ('TITLE', 'HEADING', 'PARAGRAPH')").orderBy("page_id", "block_order").collect():
        found.setdefault(r.page_id, []).append(r.text)
    for page, raw in pages.items():
        raw = re.sub(r"(?is)<(script|style|noscript|template|nav|aside|footer|form)\b.*?</\1\s*>", "", raw or "")
        roots = re.search(r"(?is)<(main|article)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", raw)
        raw = re.sub(r"(?is)<table\b.*?</table\s*>", "", roots[2] if roots else raw)
        texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", t.replace("<br>", " ")))).strip() for _, t in re.findall(rf"(?is)<(h[1-6]|p)\b[^>]*>(.*?){ends}", raw)]
        assert found.get(page, []) == [t for t in texts if t], page


def test_indexed_documents(spark):
    """The index holds a row for each recursive chunk of the cleaned text; equal texts have equal unit vectors."""
    from tessera.functions import text as tx

    clean = scan(spark, SF, "documents", "doc_id", "text").select("doc_id", tx.clean_text(F.col("text")).alias("text")).collect()
    rows = QUERIES["index_pipeline"](spark, SF).collect()
    want = sorted((str(r.doc_id), i) for r in clean for i, _ in enumerate(recursive(r.text or "", 800, 100)))
    assert sorted((r.object_id, r.chunk_index) for r in rows) == want
    vectors = {}
    for r in rows:
        assert vectors.setdefault(r.content_hash, r.embedding) == r.embedding and abs(sum(x * x for x in r.embedding) - 1) < 1e-5
