"""The given tables as the library's own: documents, chunks, notes, mentions, files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import STANDARD, chunk_words
from ..operators.index import LexicalIndex, VectorIndex
from ..operators.lineage import own_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    """id, title, source_type, language, text. The id is also the time of indexing."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("source_type"), F.col("lang").alias("language"), "text")


def chunks(spark, sf_dir: str, sizes=STANDARD) -> DataFrame:
    """doc_id, chunk_index, start_word, end_word, content."""
    return chunk_words(documents(spark, sf_dir).select("id", "text"), sizes).select(F.col("id").alias("doc_id"), "chunk_index", "start_word", "end_word", "content")


KEYS = ["doc_id", "chunk_index"]
_indexes: dict = {}


def _stored(spark, sf_dir: str, name: str, build):
    """An index of a given table, built when it is first asked for and after the table's files have changed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(table(spark, sf_dir, name).inputFiles())
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    state = tuple((f, s.getLen(), s.getModificationTime()) for f, s in zip(files, (p.getFileSystem(conf).getFileStatus(p) for p in paths)))
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _indexes or _indexes[key][0] != state:
        _indexes[key] = state, build(own_folder(spark, "index"))
    return _indexes[key][1]


def index(spark, sf_dir: str) -> LexicalIndex:
    """The stored index of the chunks."""
    return _stored(spark, sf_dir, "documents", lambda path: LexicalIndex.build(chunks(spark, sf_dir), KEYS, path))


def vector_index(spark, sf_dir: str) -> VectorIndex:
    """The stored index of the given vectors."""
    return _stored(spark, sf_dir, "embeddings", lambda path: VectorIndex.build(table(spark, sf_dir, "embeddings"), ["vec_id"], path, 64))


#: The same chunks in DuckDB.
CHUNKS_SQL = r"""
_w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
_k AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, (len(w) - 1) // 425 + 1)) AS chunk_index FROM _w WHERE len(w) > 0),
_e AS (SELECT *, chunk_index * 425 AS s, least(chunk_index * 425 + 500, n) AS cap FROM _k),
_x AS (SELECT *, CASE WHEN cap < n THEN coalesce(list_max(list_filter(range(greatest(s, cap - 50) + 1, cap + 1), lambda j: regexp_matches(w[j + 1], '[.!?;]$'))) + 1, cap) ELSE cap END AS e FROM _e),
chunks AS (SELECT doc_id, chunk_index::INTEGER AS chunk_index, s::INTEGER AS start_word, e::INTEGER AS end_word, array_to_string(w[s + 1 : e], ' ') AS content FROM _x WHERE chunk_index = 0 OR e - s >= 100)
"""

#: Capitalised words of four letters or more: the entities of the rule extractor.
MENTION = "[A-Z][a-z]{3,}"


def mentions(spark, sf_dir: str) -> DataFrame:
    """doc_id, chunk_index, name: each capitalised word of a chunk, as often as it occurs."""
    c = chunks(spark, sf_dir)
    return c.select("doc_id", "chunk_index", F.explode(F.regexp_extract_all("content", F.lit(MENTION), F.lit(0))).alias("name"))


MENTIONS_SQL = CHUNKS_SQL + r""", mentions AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(content, '[A-Z][a-z]{3,}')) AS name FROM chunks)"""


def links(spark, sf_dir: str) -> DataFrame:
    """page_id, pos, target: the anchors of pages, targets without the leading slash."""
    p = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.posexplode(found).alias("pos", "href")).select("page_id", "pos", F.regexp_replace("href", "^/", "").alias("target"))


LINKS_SQL = r"""
_a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages),
links AS (SELECT page_id, (i - 1)::INTEGER AS pos, regexp_replace(a[i], '^/', '') AS target FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM _a))
"""
