"""Lexical rank by a positional inverted index: cover density, with early stop by block bounds.

A block is documents that stood together in a task, ordered by length, the longest first, so that the documents of a block
have like bounds and the best of most queries stand in few blocks. The index has a row for each term and block: how often the term stands
in a document of the block at most, and the block's postings as flat arrays: ids, the rows' distances from the block's
first row, which is its number, and how many positions each has, and the positions. Its files are in order of terms, so a
search reads the row groups of its terms, and of those first the heads only (term, block, most); texts are never read again.

A document's rank, to nine places, so that ties don't rest on the order of sums, is the sum over its covers, the stretches that hold all of a query's terms and no shorter one that does:
``WEIGHT`` / (1 + the number of words in the cover that are none of the query's). A document without all terms has no
rank. (Clarke, Cormack, Tudhope: Relevance ranking for one to three term queries.)

A term of m stands in at most m covers at each of its places, so a document has at most m times as many covers as its
rarest term has places; with each term's most this bounds all documents of a block. A search scores each query's blocks of
the highest bounds first, and then only those blocks whose bound reaches the k-th best rank found, and of these only the
documents whose own bound, by how often the terms stand in them, does: results are exact. All queries that want a block are
scored together, as arrays.
Queries of the same terms are scored once. A block's postings of all wanted terms and the queries that want it meet in one
task, so postings are moved once a search, not once a query, and of each query and block only k hits go on.

Null texts have no terms; a query without terms finds nothing. A document in several rows has one rank for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import written

#: What a cover without other words counts.
WEIGHT = 0.1
#: Documents of a block, and words unless it is one document; blocks that are scored for each query before bounds are applied.
BLOCK_DOCS, BLOCK_WORDS, FIRST_BLOCKS = 2048, 1 << 20, 2
#: Candidates, and occurrences unless they are one document's, that a task holds at once.
CANDIDATES, OCCURRENCES = 1 << 17, 1 << 20
#: Distinct terms of all queries up to which they are given to the scan as a list.
LISTED_TERMS = 1000


def build(docs: DataFrame, doc: str = "doc_id", text: str = "text", keywords: str | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index of documents: ``block``, ``term``, ``most``, ``ids``, ``at``, ``counts``, ``positions``, in order of term
    and block in each task.

    ``keywords``: a column whose words stand behind the text's. A block's postings are gathered and ordered where its texts
    are; nothing is moved.
    """
    said = F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(keywords), F.lit("")) if keywords else F.lit(""))
    longest = docs.select(F.col(doc).alias("id"), said.alias("said")).sortWithinPartitions(F.octet_length("said").desc())
    rows = longest.select("id", F.monotonically_increasing_id().alias("row"), tx.search_words(F.col("said")).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            begin = 0
            for i, size in enumerate(sizes.tolist()):
                if (n := sum(map(len, held)) + i - begin) and (n == block_docs or words + size > BLOCK_WORDS):
                    yield postings([*held, batch.slice(begin, i - begin)])
                    held, words, begin = [], 0, i
                words += size
            held.append(batch.slice(begin))
        if sum(map(len, held)):
            yield postings(held)

    index = rows.mapInArrow(run, f"block long, term string, most int, ids array<{kind}>, at array<int>, counts array<int>, positions array<int>")
    # a search reads of each file the pages of its terms, so files in order do, and nothing is moved
    return index.sortWithinPartitions("term", "block")


def _arrays(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def postings(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of the index that a block of documents (id, row, words) gives."""
    ids, row, words = (pa.concat_arrays([p.column(c) for p in parts]) for c in range(3))
    flat = words.flatten().dictionary_encode()
    codes, counts = np.asarray(flat.indices), np.diff(np.asarray(words.offsets))
    of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(codes, kind="stable")  # words stand in order of document and place
    of, codes, place = of[order], codes[order], place[order]
    ends = lambda new, n: np.r_[np.flatnonzero(new), n]
    begins = np.r_[True, (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])][: len(codes)]
    posting = ends(begins, len(codes))  # a document's places of a term
    doc, often = of[posting[:-1]], np.diff(posting)
    term = ends(np.r_[True, codes[posting[1:-1]] != codes[posting[:-2]]][: len(doc)], len(doc))
    most = np.maximum.reduceat(often, term[:-1]) if len(doc) else often
    block = row[0].as_py() if len(row) else 0
    names = flat.dictionary.take(pa.array(codes[posting[term[:-1]]])).cast(pa.string())
    at = (np.asarray(row)[doc] - block).astype(np.int32)
    columns = [pa.array(np.full(len(names), block, np.int64)), names, pa.array(most.astype(np.int32)), _arrays(term, ids.take(pa.array(doc))), _arrays(term, pa.array(at)), _arrays(term, pa.array(often.astype(np.int32))), _arrays(posting[term], pa.array(place.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "term", "most", "ids", "at", "counts", "positions"])


def covers(pair: np.ndarray, term: np.ndarray, place: np.ndarray, terms: np.ndarray, pairs: int) -> np.ndarray:
    """The rank of each of ``pairs`` documents from occurrences in order of pair and place; ``terms``: how many each pair's
    query has, numbered from 0."""
    n = len(pair)
    if not n:
        return np.zeros(pairs)
    at = np.arange(n)
    start = np.searchsorted(pair, np.arange(pairs))[pair]
    first = np.full(n, n)  # the latest begin from which all terms stand up to here
    for t in range(int(terms.max())):
        seen = np.maximum.accumulate(np.where(term == t, at, -1))
        first = np.where(t < terms[pair], np.minimum(first, np.where(seen >= start, seen, -1)), first)
    whole = first >= 0
    before = np.r_[-1, first[:-1]]
    # a later begin than the one before makes a cover that holds no other
    cover = np.flatnonzero(whole & ((first > before) | (at == start)))
    others = (place[cover] - place[first[cover]]) - (cover - first[cover])
    return np.bincount(pair[cover], WEIGHT / (1 + others), pairs).round(9)


def _scored(wanted: DataFrame, index: DataFrame, k: int | None = None) -> DataFrame:
    """asked, id, row, rank of the documents that have all terms, the ``k`` best of each asked and block. ``wanted``: asked,
    block, t, the distinct terms, and, if it has it, ``kth``, the rank that a document must reach to matter; a block's
    postings and those that ask for it meet in a task."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    least = (F.col("kth") if "kth" in wanted.columns else F.lit(None)).cast("double").alias("kth")
    asks = wanted.select("block", F.lit(1).alias("kind"), "asked", "t", least, *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("term", "ids", "at", "counts", "positions")])
    # what is written has a known size, so that Spark can leave the postings where they are for this
    terms = index.join(written(wanted.select("block").distinct(), "near"), "block", "left_semi")
    given = terms.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("asked"), F.lit(None).cast("array<string>").alias("t"), F.lit(None).cast("double").alias("kth"), "term", "ids", "at", "counts", "positions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {0: [], 1: []}  # a block's postings, and those that ask for it
        for batch in batches:
            of, kinds = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("block", "kind"))
            cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kinds[1:] != kinds[:-1])][: len(of)])
            for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
                if of[begin] != block:
                    yield from best_of(block, *held.values(), k)
                    block, held = int(of[begin]), {0: [], 1: []}
                held[int(kinds[begin])].append(batch.slice(begin, end - begin))
        yield from best_of(block, *held.values(), k)

    met = given.unionByName(asks).repartition("block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(run, f"asked long, id {kind}, row long, rank double")


def best_of(block: int | None, postings: list[pa.RecordBatch], asks: list[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    """The documents of a block that have all terms of those that ask for it, with their ranks, ``k`` of each."""
    if not postings or not asks:
        return
    held = pa.Table.from_batches(postings).combine_chunks()
    index = {c: held.column(c).combine_chunks() for c in ("term", "ids", "at", "counts", "positions")}
    df = np.asarray(index["at"].value_lengths(), np.int64)
    ids, at, counts, places = (index[c].flatten() if c == "ids" else np.asarray(index[c].flatten(), np.int64) for c in ("ids", "at", "counts", "positions"))
    first, place_first, docs = np.cumsum(df) - df, np.cumsum(counts) - counts, int(at.max(initial=0)) + 1
    key = np.repeat(np.arange(len(df)), df) * docs + at  # in order, as a term's documents are
    for part in asks:
        t, asked, kth = (part.column(part.schema.get_field_index(c)) for c in ("t", "asked", "kth"))
        m, code = np.asarray(t.value_lengths()), pc.index_in(t.flatten(), value_set=index["term"])
        own = np.repeat(np.arange(len(m)), m)
        has = np.bincount(own[np.asarray(code.is_valid())], minlength=len(m)) == m
        code = np.asarray(code.fill_null(0), np.int64)[has[own]]
        asked, kth, m = np.asarray(asked)[has], np.asarray(kth.fill_null(-1.0))[has], m[has]
        if not len(m):
            continue
        slots = np.full((len(m), int(m.max())), -1)
        slots[np.repeat(np.arange(len(m)), m), np.arange(len(code)) - np.repeat(np.cumsum(m) - m, m)] = code
        often = np.where(slots < 0, np.iinfo(np.int32).max, df[slots])
        rarest = slots[np.arange(len(m)), often.argmin(1)]
        for some in _parts(df[rarest], CANDIDATES):
            cand = np.repeat(np.arange(some.start, some.stop), df[rarest[some]])
            begins = np.cumsum(df[rarest[some]]) - df[rarest[some]]
            doc = at[np.arange(len(cand)) - np.repeat(begins, df[rarest[some]]) + np.repeat(first[rarest[some]], df[rarest[some]])]
            posting = np.full((len(cand), slots.shape[1]), -1)
            for j in range(slots.shape[1]):
                term = slots[cand, j]
                sought = term * docs + doc
                found = np.minimum(np.searchsorted(key, sought), len(key) - 1)
                met = (term < 0) | (key[found] == sought)
                posting[:, j] = np.where(term < 0, -1, found)
                cand, doc, posting = cand[met], doc[met], posting[met]
            n = np.where(posting < 0, 0, counts[posting])
            bound = WEIGHT * np.minimum(m[cand] * np.where(posting < 0, np.iinfo(np.int32).max, n).min(1, initial=np.iinfo(np.int32).max), n.sum(1))
            good = bound >= kth[cand] - 1e-9
            cand, doc, posting, n = cand[good], doc[good], posting[good], n[good]
            ranks = [np.zeros(0)]
            for those in _parts(n.sum(1), OCCURRENCES):
                ranks.append(_ranks(posting[those], n[those], m[cand[those]], places, place_first))
            rank = np.concatenate(ranks)
            kept = slice(None) if k is None else _best(cand, rank, ids, posting[:, 0], doc, k)
            cand, doc, rank, posting = cand[kept], doc[kept], rank[kept], posting[kept]
            if len(cand):
                yield pa.RecordBatch.from_arrays([pa.array(asked[cand]), ids.take(pa.array(posting[:, 0])), pa.array(doc + block), pa.array(rank)], names=["asked", "id", "row", "rank"])


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches whose sizes sum to ``most`` at most, or of one."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right"))
        yield slice(begin, max(end, begin + 1))
        begin = max(end, begin + 1)


def _ranks(posting: np.ndarray, n: np.ndarray, terms: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ranks of documents whose terms stand ``n`` times each, at the places of ``posting``."""
    rank = (WEIGHT * n.sum(1)).round(9)  # each place of a single term is a cover
    two, more = np.flatnonzero(terms == 2), np.flatnonzero(terms > 2)
    if len(two):
        rank[two] = _ranks_of_two(posting[two, :2], n[two, :2], places, first)
    if len(more):
        rank[more] = _ranks_of_more(posting[more], n[more], terms[more], places, first)
    return rank


def _ranks_of_two(posting: np.ndarray, n: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same of two terms each: covers are places that follow each other and are not of one term."""
    often = n.ravel()
    begins = np.cumsum(often) - often
    place = places[np.arange(int(often.sum())) + np.repeat(first[posting.ravel()] - begins, often)]
    bits = int(place.max(initial=0)).bit_length() + 1
    key = np.sort(np.repeat((np.arange(len(n))[:, None] << bits | np.arange(2)).ravel(), often) + (place << 1))
    pair = key >> bits
    cover = np.flatnonzero(((key[1:] ^ key[:-1]) & 1).astype(bool) & (pair[1:] == pair[:-1])) + 1
    gap = (key[cover] >> 1) - (key[cover - 1] >> 1)
    return np.bincount(pair[cover], WEIGHT / gap, len(n)).round(9)


def _ranks_of_more(posting: np.ndarray, n: np.ndarray, terms: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    pairs, slots = n.shape
    often = n.ravel()
    cell = np.repeat(np.arange(pairs * slots), often)
    begins = np.cumsum(often) - often
    place = places[np.arange(len(cell)) + (first[posting.ravel()] - begins)[cell]]
    pair, term = np.divmod(cell, slots)
    high = int(place.max(initial=0)) + 1
    if pairs * high * slots < 1 << 62:  # one number for pair, place and term is sorted faster than three
        pair, term = np.divmod(np.sort((pair * high + place) * slots + term), slots)
        pair, place = np.divmod(pair, high)
    else:
        order = np.lexsort((place, pair))
        pair, term, place = pair[order], term[order], place[order]
    return covers(pair, term, place, terms, pairs)


def _best(cand: np.ndarray, rank: np.ndarray, ids: pa.Array, posting: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which are the ``k`` best of each of ``cand``, which is in order; ids, nulls first, decide between equal ranks."""
    order = np.lexsort((-rank, cand))
    begins = np.searchsorted(cand, cand)
    place = np.arange(len(cand)) - begins
    kth = np.full(len(cand), -1.0)
    kth[begins[place == k - 1]] = rank[order][place == k - 1]
    some = np.flatnonzero(rank >= kth[begins])
    if len(some) and (np.bincount(cand[some]) > k).any():
        table = pa.table({"c": cand[some], "r": rank[some], "i": ids.take(pa.array(posting[some])), "d": doc[some]})
        some = some[np.asarray(pc.sort_indices(table, [("c", "ascending"), ("r", "descending"), ("i", "ascending"), ("d", "ascending")], null_placement="at_start"))]
        some = some[np.arange(len(some)) - np.searchsorted(cand[some], cand[some]) < k]
    return some


def search(index: DataFrame, queries: DataFrame, k: int, first_blocks: int = FIRST_BLOCKS, seen: dict | None = None) -> DataFrame:
    """``query_id``, ``place`` (from 1), ``id``, ``rank``: the k documents of the highest rank for each query, ties to the
    smaller id. ``queries``: query_id, query; ``index``: as ``build`` makes it, read from where it was written.
    ``seen``, if given, gets how many blocks there were, and how many were scored."""
    own_terms = queries.select("query_id", F.array_sort(tx.search_tokens(F.col("query"))).alias("t")).where(F.size("t") > 0)
    own_terms = written(own_terms, "queries")
    asked = written(own_terms.select("t").distinct().withColumn("asked", F.monotonically_increasing_id()), "asked")
    words = written(asked.select(F.explode("t").alias("term")).distinct(), "words")
    some = [r.term for r in words.limit(LISTED_TERMS + 1).collect()]
    own = index.where(F.col("term").isin(some)) if len(some) <= LISTED_TERMS else index.join(words, "term", "left_semi")
    terms = asked.select("asked", F.size("t").alias("terms"), F.explode("t").alias("term"))
    heads = own.select("term", "block", "most").join(terms, "term")
    bound = WEIGHT * F.least(F.min("most") * F.first("terms"), F.sum("most"))
    bounds = heads.groupBy("asked", "block").agg(F.count("*").alias("n"), F.first("terms").alias("m"), bound.alias("bound")).where("n = m").select("asked", "block", "bound")
    by_bound = Window.partitionBy("asked").orderBy(F.desc("bound"), "block")
    ordered = written(bounds.withColumn("turn", F.row_number().over(by_bound)), "bounds")
    blocks = lambda which: which.join(asked, "asked")
    best = Window.partitionBy("asked").orderBy(F.desc("rank"), "id", "row")
    top = lambda found: found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    begun = blocks(ordered.where(F.col("turn") <= first_blocks).select("asked", "block"))
    few = own.join(written(begun.select("block", F.explode("t").alias("term")).distinct(), "few"), ["block", "term"], "left_semi")
    first = written(top(_scored(begun, few, k)), "first")
    kth = first.where(F.col("place") == k).select("asked", F.col("rank").alias("kth"))
    left = ordered.where(F.col("turn") > first_blocks).join(kth, "asked", "left").where("kth is null or bound >= kth - 1e-9")
    if seen is not None:
        seen.update(blocks=ordered.count(), scored=ordered.where(F.col("turn") <= first_blocks).count() + left.count())
    more = _scored(blocks(written(left.select("asked", "block", "kth"), "left")), own, k)
    found = top(first.drop("place").unionByName(more)).select("asked", "place", "id", "rank")
    return own_terms.join(asked, "t").select("query_id", "asked").join(found, "asked").select("query_id", "place", "id", "rank")


def ranks(index: DataFrame, query: str) -> DataFrame:
    """``id``, ``rank`` of all documents that have a rank for the query, as hybrid search weighs them."""
    spark = index.sparkSession
    tokens = spark.range(1).select(tx.search_tokens(F.lit(query)).alias("t")).first().t
    own = index.where(F.col("term").isin(tokens))
    wanted = own.select("block").distinct().select(F.lit(0).cast("long").alias("asked"), "block", F.array(*map(F.lit, tokens)).cast("array<string>").alias("t"))
    return _scored(wanted, own).select("id", "rank")


def hybrid_top_k(store: DataFrame, index: DataFrame, query: str, distance: Column, k: int, weights: tuple[float, float] = (0.7, 0.3), doc: str = "doc_id") -> DataFrame:
    """The k rows of the least weighted distance less weighted rank; rows without a rank count with their distance alone."""
    found = store.withColumn("distance", distance).join(ranks(index, query).withColumnRenamed("id", doc), doc, "left")
    hybrid = F.col("distance") * weights[0] - F.coalesce("rank", F.lit(0.0)) * weights[1]
    return found.withColumn("hybrid", hybrid).orderBy("hybrid", doc).limit(k)
