"""Dense and hybrid retrieval; queries come many at a time. The lexical side is in index.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact_hit, keywords
from ..functions.vectors import finite

# BM25's and the fusion's constants.
K1, B = 1.5, 0.75
RRF_K, DENSE, SPARSE, BOOST = 60, 0.6, 0.4, 2.0


def top(df: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their zero-based rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col(rank) < k)


def valid_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """Rows of vectors (embedding) of the right length with finite parts only."""
    return vectors.where((F.size("embedding") == width) & finite(F.col("embedding")))


#: Queries that meet a batch of vectors at once, and vectors that meet a block of queries where queries are many.
QUERIES, VECTORS = 256, 16_384


def _unit_rows(column):
    """Row numbers and unit vectors of an Arrow column of lists, by length. Null, zero and non-finite ones are left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(at)).flatten()
        v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
        norm = np.sqrt((v * v).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        yield int(width), at[good], v[good] / norm[good, None]


def _meet(queries, vectors, k: int, schema):
    """The k best rows of vectors for each of queries (Arrow tables), by similarity to six digits and then by id."""
    import numpy as np
    import pyarrow as pa

    plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x
    score = np.zeros((queries.num_rows, vectors.num_rows))
    of_vectors = {w: (at, v) for w, at, v in _unit_rows(vectors["embedding"])}
    for width, at, q in _unit_rows(queries["query"]):
        if width in of_vectors:
            there, v = of_vectors[width]
            score[np.ix_(at, there)] = q @ v.T
    score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
    ids, which, best = vectors["vec_id"].to_pylist(), [], []
    for row in score:
        if len(row) > k:
            near = np.flatnonzero(row >= np.partition(row, -k)[-k])
        else:
            near = np.arange(len(row))
        best.append(sorted(near.tolist(), key=lambda j: (-row[j], plain(ids[j])))[:k])
        which.append([float(row[j]) for j in best[-1]])
    at = [j for found in best for j in found]
    q = [i for i, found in enumerate(best) for _ in found]
    return pa.table([queries["query_id"].take(pa.array(q, pa.int64())), vectors["vec_id"].take(pa.array(at, pa.int64())), pa.array([x for w in which for x in w], pa.float64())], schema=schema)


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, score, rank: the k most similar of vectors (vec_id, embedding) to each of queries (query_id, query).

    Batches of vectors meet all queries where a count shows these to be few; else blocks of queries meet blocks of
    vectors. Each keeps k rows a query, so that what is ranked at last grows with neither side's product. The
    similarity to null, zero, non-finite or otherwise long vectors is 0.
    """
    q, v = queries.select("query_id", "query"), vectors.select("vec_id", "embedding")
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {v.schema['vec_id'].dataType.simpleString()}, score double"

    def schema(a, b):
        import pyarrow as pa

        return pa.schema([("query_id", a.field("query_id").type), ("vec_id", b.field("vec_id").type), ("score", pa.float64())])

    if queries.limit(QUERIES + 1).count() <= QUERIES:
        asked = q.toArrow().combine_chunks()

        def near(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows and asked.num_rows:
                    yield from _meet(asked, pa.Table.from_batches([batch]), k, schema(asked.schema, batch.schema)).to_batches()

        found = v.mapInArrow(near, kinds)
    else:
        blocks, parts = (-(-n // size) for n, size in ((q.count(), QUERIES), (max(1, v.count()), VECTORS)))
        deal = lambda df, column, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        left, right = deal(q, "query_id", "block", blocks, "part", parts), deal(v, "vec_id", "part", parts, "block", blocks)

        def near_blocks(asked, held):
            return _meet(asked, held, k, schema(asked.schema, held.schema))

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(near_blocks, kinds)
    return top(found, k, ["query_id"], [F.desc("score"), "vec_id"])


def nearest_then_filter(vectors: DataFrame, queries: DataFrame, k: int, keep: Column) -> DataFrame:
    """As an index with a filter behind it: twice k candidates, then the filter, then k."""
    found = exact_nearest(vectors, queries, 2 * k).join(vectors.select("vec_id", *[c for c in vectors.columns if c not in ("vec_id", "embedding")]), "vec_id").where(keep)
    return top(found.drop("rank"), k, ["query_id"], [F.desc("score"), "vec_id"]).select("query_id", "vec_id", "score", "rank")


def fuse(dense: DataFrame, sparse: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, keys, score, and the rank in each list: reciprocal rank fusion of (query_id, keys, rank)."""
    part = lambda d, w, a, b: d.select("query_id", *keys, (w / (RRF_K + F.col("rank") + 1)).alias("part"), a.alias("dense_rank"), b.alias("sparse_rank"))
    none = F.lit(None).cast("int")
    both = part(dense, F.lit(DENSE), F.col("rank"), none).unionByName(part(sparse, F.lit(SPARSE), none, F.col("rank")))
    return both.groupBy("query_id", *keys).agg(F.sum("part").alias("score"), F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))


def hybrid(dense: DataFrame, sparse: DataFrame, contents: DataFrame, queries: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Fused ranks, doubled where a keyword of the query stands in the content; the best k for each query.

    dense and sparse hold max(5 k, 50) candidates a query; contents (keys, content), queries (query_id, text).
    """
    fused, asked = fuse(dense, sparse, keys), queries.select("query_id", keywords(F.col("text")).alias("keys_"))
    # Few queries' candidates go to the contents, which then stay where they are.
    send = F.broadcast if queries.limit(QUERIES + 1).count() <= QUERIES else lambda df: df
    fused = contents.join(send(fused), keys).join(send(asked), "query_id")
    boosted = F.col("score") * F.when(exact_hit(F.col("content"), F.col("keys_")), BOOST).otherwise(1.0)
    fused = fused.select("query_id", *keys, F.round(boosted, 8).alias("score"), "dense_rank", "sparse_rank")
    return top(fused, k, ["query_id"], [F.desc("score"), *keys])


def mean_vector(vectors: DataFrame, by: list[str]) -> DataFrame:
    """by and the element-wise mean of embedding."""
    parts = vectors.select(*by, F.posexplode("embedding").alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))


def similar_parents(vectors: DataFrame, parents: DataFrame, k: int = 10, sample: int = 5) -> DataFrame:
    """parent, other, score, rank: for each of parents (parent), others whose vectors are near its mean vector.

    vectors (vec_id, parent, embedding). A parent's mean is of its first vectors; three times k hits are
    fetched, the best for each other parent stays, and k of them.
    """
    first = top(vectors.join(parents, "parent", "left_semi"), sample, ["parent"], [F.col("vec_id")])
    centre = mean_vector(first, ["parent"]).select(F.col("parent").alias("query_id"), F.col("embedding").alias("query"))
    hits = exact_nearest(vectors, centre, 3 * k).join(vectors.select("vec_id", F.col("parent").alias("other")), "vec_id").where("other <> query_id").drop("rank")
    best = top(hits, 1, ["query_id", "other"], [F.desc("score"), F.col("vec_id")]).drop("rank")
    return top(best, k, ["query_id"], [F.desc("score"), "vec_id"]).select(F.col("query_id").alias("parent"), "other", "score", "rank")
