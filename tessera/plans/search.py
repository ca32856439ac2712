"""Queries over vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import filters, lexical, retrieval, trigrams
from tessera.plans.registry import query
from tessera.session import scan, written

#: The query of the fixed searches: the vector of id 0, a bounded read of one row.
Q = "(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = scan(spark, sf_dir, "embeddings", "vec_id", "embedding").where("vec_id = 0").select("embedding").first()
    return list(row.embedding)


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"""SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.v), 6) AS distance,
  round(1 / (1 + list_distance(e.embedding::DOUBLE[], q.v)), 6) AS score
FROM embeddings e, {Q} q ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id LIMIT 5""")
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return _shown(retrieval.top_k(store, _query_vector(spark, sf_dir), 5), "vec_id")


@query(f"""SELECT e.vec_id, e.label, round(list_distance(e.embedding::DOUBLE[], q.v), 6) AS distance,
  round(1 / (1 + list_distance(e.embedding::DOUBLE[], q.v)), 6) AS score
FROM embeddings e, {Q} q WHERE CAST(e.label AS VARCHAR) IN ('3', '4')
ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id LIMIT 10""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    where = filters.MetadataFilter(among={"label ": [3, 4, 4, ""]}).predicate(F.col("metadata"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return _shown(retrieval.top_k(store, _query_vector(spark, sf_dir), 10, where), "vec_id", "label")


@query(f"""SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM (
  SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.v) AS d FROM embeddings e, {Q} q WHERE e.label = 2 AND CAST(e.vec_id AS VARCHAR) LIKE '1%'
  ORDER BY d, e.vec_id LIMIT 10)""")
def vector_topk_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").where(F.col("vec_id").cast("string").startswith("1"))
    scope = filters.MetadataFilter(object_type="2").predicate(F.create_map(), F.col("label").cast("string"), F.col("vec_id").cast("string"))
    return _shown(retrieval.top_k(store, _query_vector(spark, sf_dir), 10, scope), "vec_id")


@query(f"""SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM (
  SELECT e.label, e.vec_id, list_distance(e.embedding::DOUBLE[], q.v) AS d,
    row_number() OVER (PARTITION BY e.label ORDER BY list_distance(e.embedding::DOUBLE[], q.v), e.vec_id) AS rank
  FROM embeddings e, {Q} q) WHERE rank <= 3""")
def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("distance", vx.l2_distance(F.col("embedding"), vx.literal(_query_vector(spark, sf_dir))))
    w = Window.partitionBy("label").orderBy("distance", "vec_id")
    return store.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("label", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    asked = store.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _shown(retrieval.top_k_each(store, asked, 5), "query_id", "vec_id", "rank")


@query(f"""SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (
  SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.v) AS d FROM embeddings e, {Q} q ORDER BY d, e.vec_id LIMIT 20)
WHERE 1 / (1 + d) >= 0.5""")
def vector_min_score_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return retrieval.min_score(retrieval.top_k(store, _query_vector(spark, sf_dir), 20), 0.5).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS similarity
FROM embeddings e, {Q} q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.v) DESC, e.vec_id LIMIT 10""")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = store.withColumn("s", vx.cosine(F.col("embedding"), vx.literal(_query_vector(spark, sf_dir)))).orderBy(F.desc("s"), "vec_id").limit(10)
    return found.select("vec_id", F.round("s", 6).alias("similarity"))


@query("""SELECT vec_id, len(embedding) AS dimension, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_unit FROM embeddings""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    unit = vx.normalised(F.col("embedding"))
    return store.select("vec_id", F.size("embedding").cast("long").alias("dimension"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"), F.round(F.get(unit, F.lit(0)), 6).alias("first_unit"))


TOKENS = r"list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> ''))"
ASKED = "the and passage of with"


@query(f"""WITH q AS (SELECT list_distinct(string_split('{ASKED}', ' ')) AS t)
SELECT doc_id, round(len(list_intersect({TOKENS}, q.t)) / len(q.t), 6) AS lexical FROM documents, q
WHERE len(list_intersect({TOKENS}, q.t)) > 0 ORDER BY 2 DESC, 1 LIMIT 25""")
def lexical_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_top_k(scan(spark, sf_dir, "documents", "doc_id", "text"), ASKED, 25).select("doc_id", F.round("lexical", 6).alias("lexical"))


PATTERNS = ("passage", "the _ther", "of%th_%license", "ab", "no such words")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id FROM documents WHERE lower(text) LIKE '%{p}%'" for p in PATTERNS))
def contains_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain each pattern, by one index of grams."""
    index = trigrams.build(scan(spark, sf_dir, "documents", "doc_id", "text"))
    found = None
    for p in PATTERNS:
        part = trigrams.contains(index, p).select(F.lit(p).alias("pattern"), "doc_id")
        found = part if found is None else found.unionByName(part)
    return found


def _text_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return docs.join(scan(spark, sf_dir, "embeddings", F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


@query(f"""WITH q AS (SELECT list_distinct(string_split('{ASKED}', ' ')) AS t, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS v),
s AS (SELECT doc_id, list_distance(embedding::DOUBLE[], q.v) AS d, len(list_intersect({TOKENS}, q.t)) / len(q.t) AS l
  FROM documents JOIN embeddings ON doc_id = vec_id, q WHERE lang = 'en')
SELECT doc_id, round(d * 0.7 - l * 0.3, 6) AS hybrid, round(1 / (1 + d), 6) AS score FROM s ORDER BY d * 0.7 - l * 0.3, doc_id LIMIT 10""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.hybrid_top_k(_text_store(spark, sf_dir), ASKED, _query_vector(spark, sf_dir), 10, F.col("lang") == "en")
    return found.select("doc_id", F.round("hybrid", 6).alias("hybrid"), F.round("score", 6).alias("score"))


#: Words of a text and, behind them, of its source, as a list; those of two terms that follow each other with no other
#: of the two between them, and are unlike, are a cover.
WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '') || ' ' || coalesce(source, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _covers_sql(asked: str) -> str:
    """Ranks ``r`` (query_id, doc_id, rank) of the queries (query_id, a, b) that ``asked`` selects from ``w`` (doc_id, words)."""
    return f"""w AS (SELECT doc_id, {WORDS} AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM w),
q AS ({asked}),
o AS (SELECT query_id, doc_id, pos, term, a = b AS one FROM p JOIN q ON term = a UNION ALL SELECT query_id, doc_id, pos, term, false FROM p JOIN q ON term = b AND a <> b),
l AS (SELECT *, lag(pos) OVER g AS before, lag(term) OVER g AS last FROM o WINDOW g AS (PARTITION BY query_id, doc_id ORDER BY pos)),
r AS (SELECT query_id, doc_id, round(sum(CASE WHEN one THEN 0.1::DOUBLE ELSE 0.1::DOUBLE / (pos - before) END), 9) AS rank FROM l WHERE one OR term <> last GROUP BY query_id, doc_id)"""


@query(f"""WITH {_covers_sql("SELECT doc_id AS query_id, words[1] AS a, words[2] AS b FROM w WHERE doc_id % 50 = 0 AND len(words) >= 2")}
SELECT query_id, CAST(n AS INTEGER) AS place, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS n FROM r) WHERE n <= 10""")
def lexical_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of every 50th document, in all documents and their keywords."""
    docs = scan(spark, sf_dir, "documents", "doc_id", "text", "source")
    index = written(lexical.build(docs, keywords="source"), "lexical")
    words = tx.search_words(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))))
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), words.alias("w")).where("size(w) >= 2").select("query_id", F.concat_ws(" ", F.slice("w", 1, 2)).alias("query"))
    return lexical.search(index, asked, 10).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_covers_sql("SELECT 0 AS query_id, 'of' AS a, 'the' AS b")},
s AS (SELECT vec_id AS doc_id, list_distance(embedding::DOUBLE[], v.v) AS d FROM embeddings, {Q} v)
SELECT s.doc_id, round(s.d * 0.7 - coalesce(r.rank, 0) * 0.3, 6) AS hybrid, r.rank FROM s LEFT JOIN r ON s.doc_id = r.doc_id ORDER BY s.d * 0.7 - coalesce(r.rank, 0) * 0.3, s.doc_id LIMIT 20""")
def hybrid_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written(lexical.build(scan(spark, sf_dir, "documents", "doc_id", "text", "source"), keywords="source"), "lexical")
    store = scan(spark, sf_dir, "embeddings", F.col("vec_id").alias("doc_id"), "embedding")
    found = lexical.hybrid_top_k(store, index, "of the", vx.l2_distance(F.col("embedding"), vx.literal(_query_vector(spark, sf_dir))), 20)
    return found.select("doc_id", F.round("hybrid", 6).alias("hybrid"), "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS want FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, 1 / (1 + list_distance(embedding::DOUBLE[], v)) AS score, want, label FROM embeddings, q),
a AS (SELECT *, 0 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s WHERE label = want + 100
  UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) FROM s WHERE label = want AND query_id % 100 = 0
  UNION ALL SELECT *, 2, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) FROM s),
k AS (SELECT query_id, min(stage) AS stage FROM a WHERE n <= 4 AND score >= 0.15 GROUP BY query_id)
SELECT query_id, CAST(stage AS INTEGER) AS stage, vec_id, round(score, 6) AS score FROM a JOIN k USING (query_id, stage) WHERE n <= 4""")
def retrieval_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scan(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    asked = store.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    absent, some = asked.withColumn("label", F.col("label") + 100), asked.where("query_id % 100 = 0")
    stages = [retrieval.top_k_each(store, absent, 4, same="label"), retrieval.top_k_each(store, some, 4, same="label"), retrieval.top_k_each(store, asked, 4)]
    return retrieval.cascade(stages).select("query_id", "stage", "vec_id", F.round("score", 6).alias("score"))


@query("""SELECT label AS object_id, arg_min(vec_id, vec_id) AS first_vec FROM embeddings GROUP BY label""")
def chunk_metadata_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "embeddings", "vec_id", "label").select(F.lit("v").alias("object_type"), F.col("label").alias("object_id"), F.col("vec_id").alias("chunk_index"), F.create_map(F.lit("vec"), F.col("vec_id")).alias("metadata"))
    return retrieval.first_metadata(rows).select("object_id", F.col("metadata")["vec"].alias("first_vec"))


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"""


@query(f"SELECT doc_id, sha256({CLEAN}) AS clean_hash, length({CLEAN}) AS clean_chars FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tx.clean_text(F.col("text"))
    return scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.content_hash(clean).alias("clean_hash"), F.length(clean).cast("long").alias("clean_chars"))


SQUEEZED = r"regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(f"SELECT doc_id, CAST(CASE WHEN length({SQUEEZED}) = 0 THEN 0 ELSE greatest(1, ceil(length({SQUEEZED}) / 4.0)) END AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def dup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT doc_id FROM documents b WHERE doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 2 = 0 AND sha256(d.text) = sha256(b.text))")
def exists_by_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    return docs.where("doc_id % 2 = 1").join(docs.where("doc_id % 2 = 0"), "h", "left_semi").select("doc_id")


@query("""SELECT doc_id, source || ' > ' || lang AS path, lower(lang) AS first_term,
  CASE WHEN lower(source) = lower(lang) THEN 1 ELSE 2 END AS terms FROM documents""")
def heading_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", "doc_id", "source", "lang")
    terms = tx.first_seen(F.array(F.lower("lang"), F.concat(F.lit("  "), F.upper("lang")), F.lit(" "), F.col("source")))
    return docs.select("doc_id", tx.heading_path(F.array(F.col("source"), F.lit(" "), F.col("lang"))).alias("path"), F.get(terms, F.lit(0)).alias("first_term"), F.size(terms).alias("terms"))


@query("""SELECT item_id, 'find ' || item_id || ' alpha beta' AS enriched FROM benchmark""")
def query_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.keyword_list(F.lit('```json\n["alpha", "Alpha", " beta "]\n```'))
    return scan(spark, sf_dir, "benchmark", "item_id").select("item_id", tx.enriched_query(F.concat(F.lit("find "), F.col("item_id").cast("string")), words, 5).alias("enriched"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || json_extract_string(props, '$.k') AS tagged FROM events""")
def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return scan(spark, sf_dir, "events", "event_id", "event_type", "props").select("event_id", k.cast("long").alias("k"), F.concat("event_type", F.lit(":"), k).alias("tagged"))
