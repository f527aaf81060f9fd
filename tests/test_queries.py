"""Every registered query against its DuckDB SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from foliospark.plans.registry import QUERIES, SQL

from . import oracle


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in SQL:
        oracle.same(spark, sf_dir, QUERIES[name], SQL[name])
    else:
        QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "chunk_index", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("table", ["documents", "benchmark", "pages", "embeddings", "conversations", "events"])
def test_empty_tables(spark, sf_dir, tmp_path, table):
    import os

    for t in oracle.TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == table:
            df.limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    reads = {"documents": ["bm25_topk", "cooccurrence", "graph_edges", "docs_by_source"], "benchmark": ["bm25_topk", "hybrid_rrf"], "pages": ["html_text", "link_resolution", "bfs_neighbors"], "embeddings": ["cosine_topk", "similar_docs"], "conversations": ["export_conversation"], "events": ["debounce_last_event"]}
    for name in reads[table]:
        QUERIES[name](spark, str(tmp_path)).collect()
