"""Queries on chunks, lexical, dense and hybrid retrieval."""

from pyspark.sql import functions as F

from ..operators import search

from .registry import query
from .views import CHUNKS_SQL, KEYS, chunks, documents, index, table, vector_index


@query("chunk_words", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, start_word, end_word, md5(content) AS content_md5 FROM chunks")
def chunk_words_query(spark, sf_dir):
    return chunks(spark, sf_dir).select(*KEYS, "start_word", "end_word", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("chunk_stats", f"WITH {CHUNKS_SQL} SELECT count(*)::BIGINT AS n_chunks, count(DISTINCT doc_id)::BIGINT AS n_docs, sum(end_word - start_word)::BIGINT AS n_words, max(end_word - start_word)::INTEGER AS longest FROM chunks")
def chunk_stats(spark, sf_dir):
    size = F.col("end_word") - F.col("start_word")
    return chunks(spark, sf_dir).agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.sum(size).cast("long").alias("n_words"), F.max(size).alias("longest"))


TERMS_SQL = CHUNKS_SQL + r""",
toks AS (SELECT doc_id, chunk_index, regexp_extract_all(lower(content), '[a-zà-ÿ0-9-]{2,}') AS t FROM chunks),
posts AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest(t) AS term FROM toks) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
idfs AS (SELECT term, count(*) AS df, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM posts, corpus GROUP BY term, n)
"""


@query("bm25_terms", f"WITH {TERMS_SQL} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idfs")
def bm25_terms(spark, sf_dir):
    return index(spark, sf_dir).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query("postings", f"WITH {TERMS_SQL} SELECT doc_id, chunk_index, term, tf::BIGINT AS tf FROM posts")
def postings(spark, sf_dir):
    return index(spark, sf_dir).postings.select(*KEYS, "term", "tf")


@query("chunk_lengths", f"WITH {TERMS_SQL} SELECT doc_id, chunk_index, len(t)::INTEGER AS n_terms FROM toks")
def chunk_lengths(spark, sf_dir):
    return index(spark, sf_dir).texts.select(*KEYS, F.col("len").alias("n_terms"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_SQL = TERMS_SQL + r""",
asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ0-9-]{2,}')) AS term FROM benchmark) GROUP BY ALL),
sparse_scores AS (
  SELECT query_id, doc_id, chunk_index, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avgdl))), 6) AS score
  FROM asked JOIN posts USING (term) JOIN idfs USING (term) JOIN toks USING (doc_id, chunk_index), corpus GROUP BY ALL
), sparse AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) - 1)::INTEGER AS rank FROM sparse_scores WHERE score > 0)
"""


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, chunk_index, score, rank FROM sparse WHERE rank < 10")
def bm25_topk(spark, sf_dir):
    """The ten best chunks for each text of benchmark."""
    return index(spark, sf_dir).search(_questions(spark, sf_dir), 10)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _every_hundredth(spark, sf_dir):
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


DENSE_SQL = r"""
dense_scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0
), dense AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank FROM dense_scores)
"""


@query("cosine_topk", f"WITH {DENSE_SQL} SELECT query_id, vec_id, score, rank FROM dense WHERE rank < 10")
def cosine_topk(spark, sf_dir):
    return search.exact_nearest(_vectors(spark, sf_dir), _every_hundredth(spark, sf_dir), 10)


@query(
    "cosine_topk_filtered",
    f"WITH {DENSE_SQL} SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank FROM dense WHERE rank < 20 AND label IN (1, 3, 5, 7) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10",
)
def cosine_topk_filtered(spark, sf_dir):
    """The filter works on twice ten candidates, so that a query may get fewer than ten."""
    return search.nearest_then_filter(_vectors(spark, sf_dir), _every_hundredth(spark, sf_dir), 10, F.col("label").isin(1, 3, 5, 7))


@query("vector_index_topk")
def vector_index_topk(spark, sf_dir):
    """The 10 nearest by the stored inverted lists, for every hundredth vector."""
    return vector_index(spark, sf_dir).search(_every_hundredth(spark, sf_dir), 10)


@query("vector_index_recall", "SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings))::BIGINT AS n_found, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, sf_dir):
    """How many neighbours the inverted lists find for each query, and whether nine in ten of all are the exact ones."""
    held, asked = vector_index(spark, sf_dir), _every_hundredth(spark, sf_dir)
    found = held.search(asked, 10).select("query_id", "vec_id")
    right = found.join(held.exact(asked, 10).select("query_id", "vec_id", F.lit(1).alias("right")), ["query_id", "vec_id"], "left")
    each = right.groupBy("query_id").agg(F.count("*").alias("n_found"), F.sum("right").alias("right"))
    total = each.agg((F.sum("right") >= 0.9 * F.sum("n_found")).alias("reached"))
    return each.select("query_id", "n_found").crossJoin(total)


@query("valid_vectors", "SELECT count(*)::BIGINT AS n_valid, (SELECT count(*) FROM embeddings)::BIGINT AS n_all FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))")
def valid_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.valid_vectors(v, 64).agg(F.count("*").alias("n_valid")).crossJoin(v.agg(F.count("*").alias("n_all")))


@query("vector_width", "SELECT len(embedding)::INTEGER AS width FROM embeddings ORDER BY vec_id LIMIT 1")
def vector_width(spark, sf_dir):
    return _vectors(spark, sf_dir).orderBy("vec_id").limit(1).select(F.size("embedding").alias("width"))


@query("chunks_with_vectors", "SELECT vec_id, len(embedding)::INTEGER AS width, source FROM embeddings JOIN documents ON vec_id = doc_id WHERE source IN ('src0', 'src1', 'src2') AND len(embedding) > 0")
def chunks_with_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return _vectors(spark, sf_dir).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).join(d, F.col("vec_id") == F.col("doc_id")).where(F.col("source").isin("src0", "src1", "src2")).select("vec_id", F.size("embedding").alias("width"), "source")


@query("mean_vector", "SELECT label, (pos - 1)::INTEGER AS pos, round(avg(embedding[pos]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(pos) GROUP BY label, pos")
def mean_vector(spark, sf_dir):
    return search.mean_vector(_vectors(spark, sf_dir), ["label"]).select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@query(
    "similar_docs",
    r"""WITH f AS (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5),
    m AS (SELECT label, list(x ORDER BY pos) AS q FROM (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS x FROM f, range(1, 65) r(pos) GROUP BY label, pos) GROUP BY label),
    s AS (SELECT m.label AS parent, e.label AS other, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM m, embeddings e QUALIFY row_number() OVER (PARTITION BY m.label ORDER BY round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) DESC, vec_id) <= 30),
    b AS (SELECT * FROM s WHERE other <> parent QUALIFY row_number() OVER (PARTITION BY parent, other ORDER BY score DESC, vec_id) = 1)
    SELECT parent, other, score, (row_number() OVER (PARTITION BY parent ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank FROM b QUALIFY row_number() OVER (PARTITION BY parent ORDER BY score DESC, vec_id) <= 10""",
)
def similar_docs(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("label", "parent")
    return search.similar_parents(v, v.select("parent").distinct(), 10)


def _paired_queries(spark, sf_dir):
    """Benchmark texts, each with the vector of its number as if it were its embedding; none where there is none."""
    v = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("query"))
    return _questions(spark, sf_dir).join(v, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "text", "query")


def hybrid_hits(spark, sf_dir, k=10):
    """A text without a vector is answered by the lexical side alone."""
    held, q = index(spark, sf_dir), _paired_queries(spark, sf_dir)
    v = _vectors(spark, sf_dir).join(held.texts.where("chunk_index = 0").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    dense = search.exact_nearest(v, q.where("query is not null").select("query_id", "query"), 50).select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "rank")
    sparse = held.search(q.select("query_id", "text"), 50).select("query_id", *KEYS, "rank")
    return search.hybrid(dense, sparse, held.texts.select(*KEYS, "content"), q.select("query_id", "text"), KEYS, k)


HYBRID_SQL = BM25_SQL + r""",
q AS (SELECT item_id AS query_id, text, embedding AS q FROM benchmark LEFT JOIN embeddings ON item_id = vec_id),
dense_hits AS (SELECT query_id, vec_id AS doc_id, 0 AS chunk_index, (row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) DESC, vec_id) - 1)::INTEGER AS rank
  FROM q, embeddings WHERE q IS NOT NULL AND vec_id IN (SELECT doc_id FROM chunks WHERE chunk_index = 0)),
parts AS (SELECT query_id, doc_id, chunk_index, 0.6::DOUBLE / (61 + rank) AS part, rank AS dense_rank, NULL::INTEGER AS sparse_rank FROM dense_hits WHERE rank < 50
  UNION ALL SELECT query_id, doc_id, chunk_index, 0.4::DOUBLE / (61 + rank), NULL, rank FROM sparse WHERE rank < 50 AND query_id IN (SELECT query_id FROM q)),
fused AS (SELECT query_id, doc_id, chunk_index, sum(part) AS score, min(dense_rank) AS dense_rank, min(sparse_rank) AS sparse_rank FROM parts GROUP BY ALL),
boosted AS (SELECT query_id, doc_id, chunk_index, dense_rank, sparse_rank, round(score * CASE WHEN list_bool_or(list_transform(regexp_extract_all(lower(text), '[a-zà-ÿ0-9-]{5,}'), lambda k: contains(lower(content), k))) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 8) AS score
  FROM fused JOIN chunks USING (doc_id, chunk_index) JOIN q USING (query_id)),
hybrid AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) - 1)::INTEGER AS rank FROM boosted)
"""


@query("hybrid_rrf", f"WITH {HYBRID_SQL} SELECT query_id, doc_id, chunk_index, score, dense_rank, sparse_rank, rank FROM hybrid WHERE rank < 10")
def hybrid_rrf(spark, sf_dir):
    return hybrid_hits(spark, sf_dir, 10)


@query("first_chunk_excerpt", f"WITH {CHUNKS_SQL} SELECT d.doc_id, substr(c.content, 1, 200) AS excerpt FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id AND c.chunk_index = 0")
def first_chunk_excerpt(spark, sf_dir):
    c = chunks(spark, sf_dir).groupBy("doc_id").agg(F.min_by("content", "chunk_index").alias("content"))
    return table(spark, sf_dir, "documents").select("doc_id").join(c, "doc_id", "left").select("doc_id", F.substring("content", 1, 200).alias("excerpt"))


@query("chunks_in_order", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, source AS source_type, length(content)::INTEGER AS n_chars FROM chunks LEFT JOIN documents USING (doc_id)")
def chunks_in_order(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "source_type")
    return chunks(spark, sf_dir).join(d, "doc_id", "left").select(*KEYS, "source_type", F.length("content").alias("n_chars")).orderBy(*KEYS)


