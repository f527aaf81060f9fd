"""Work that grows with the input: what is shuffled, what a task holds."""

from pyspark.sql import functions as F

from foliospark.operators import graph, store
from foliospark.operators import index as stored
from foliospark.operators import search
from foliospark.operators.index import LexicalIndex

KEYS = ["doc_id", "chunk_index"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_lie_in_as_many_files_as_their_number_calls_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LexicalIndex, "SORTED", 50)
    texts = [(i, 0, " ".join(f"w{(i * 7 + j) % 90}" for j in range(20)) + " same same") for i in range(100)] + [(100, 0, ""), (101, 0, None)]
    held = LexicalIndex.build(spark.createDataFrame(texts, "doc_id long, chunk_index int, content string"), KEYS, f"file://{tmp_path}/index")
    files = [f for f in (tmp_path / "index" / "postings").rglob("*.parquet")]
    assert len(files) > 30 and max(spark.read.parquet(*map(str, files)).groupBy(F.input_file_name()).count().toPandas()["count"]) < 200
    want = {(i, t): text.split().count(t) for i, _, text in texts if text for t in text.split()}
    assert {(r.doc_id, r.term): r.tf for r in held.postings.collect()} == want
    assert {r.doc_id: r.len for r in held.texts.collect()} == {i: None if t is None else len(t.split()) for i, _, t in texts}
    # As many tasks score them, and a task's best chunks are those of all its batches.
    asked = spark.createDataFrame([(0, "same w3")], "query_id int, text string")
    assert [r.rank for r in held.search(asked, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.doc_id for r in held.search(asked, 200).orderBy("rank").collect()][:3] == [r.doc_id for r in held.search(asked, 3).orderBy("rank").collect()]


def test_terms_are_counted_where_the_chunk_is():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([["b", "a", "b"], None, [], ["a"]], pa.list_(pa.string()))], names=["id", "terms"])
    (out,) = stored._counted([batch])
    assert out["len"].to_pylist() == [3, None, 0, 1]
    assert [dict(zip(t, n, strict=True)) for t, n in zip(out["term"].to_pylist(), out["tf"].to_pylist(), strict=True)] == [{"b": 2, "a": 1}, {}, {}, {"a": 1}]


def test_few_questions_leave_contents_where_they_are(spark):
    hits = spark.createDataFrame([(0, 1, 0, 0)], "query_id int, doc_id long, chunk_index int, rank int")
    contents = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("war").alias("content"))
    asked = spark.createDataFrame([(0, "peace")], "query_id int, text string")
    found = search.hybrid(hits, hits, contents, asked, KEYS, 3)
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)


def test_a_common_target_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 8)
    links = spark.createDataFrame([(i, "x") for i in range(60)] + [(i, "y") for i in range(3)] + [(7, "none"), (None, "y")], "source long, target string")
    notes = spark.createDataFrame([(i, f"p{i}.md", "x") for i in range(50)] + [(90, "y.md", "y"), (91, "z.md", None)], "id long, relative_path string, title string")
    met = graph.resolve_links(links, notes)
    want = {(i, "x", k) for i in range(60) for k in range(50)} | {(i, "y", 90) for i in range(3)} | {(7, "none", None), (None, "y", 90)}
    assert met.count() == len(want) and set(map(tuple, met.collect())) == want
    tasks = met.where("target = 'x'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 1500


def test_backlinks_are_counted_without_pairs(spark):
    rows = [(i, "x") for i in range(60)] + [(i, "q") for i in range(40, 80)] + [(5, "solo"), (None, "x")]
    links = spark.createDataFrame(rows + rows, "source long, target string")
    notes = spark.createDataFrame([(0, "a.md", "x"), (1, "b.md", "x"), (99, "q.md", "x"), (45, "q.md", "x"), (5, "solo.md", "-"), (6, "c.md", "nothing")], "id long, relative_path string, title string")
    found = graph.backlinks(links, notes)
    assert {tuple(r) for r in found.collect()} == {(0, 59, 1), (1, 59, 0), (99, 80, 0), (45, 79, 0)}
    slow = graph.resolve_links(links.distinct(), notes).where("note_id is not null and source <> note_id").groupBy("note_id").agg(F.countDistinct("source").alias("n_backlinks"), F.min("source").alias("first_source"))
    assert {tuple(r) for r in slow.collect()} == {tuple(r) for r in found.collect()}


def test_starts_are_searched_from_as_bits(spark, monkeypatch):
    monkeypatch.setattr(graph, "BITS", 4)
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(12)] + [("x", "y")], "a string, b string")
    starts = spark.createDataFrame([(f"n{i:03}",) for i in range(13)] * 2 + [("lonely",)], "start string")
    pairs = spark.createDataFrame([("n000", "n009"), ("n000", "n002"), ("n001", "y"), ("n003", "gone")], "start string, target string")
    got = [tuple(r) for r in graph.distances(edges, starts, 2, pairs).collect()]
    want = {(f"n{i:03}", f"n{j:03}", abs(i - j)) for i in range(13) for j in range(13) if abs(i - j) <= 2} | {("lonely", "lonely", 0), ("n000", "n009", 9)}
    assert len(got) == len(want) and set(got) == want


def test_steps_of_communities_send_no_table_through_the_driver(spark):
    labels = spark.createDataFrame([("a", 1.0, 0.0, "a"), ("b", 1.0, 0.0, "b")], "node string, k double, loop double, label string")
    both = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "node string, other string, w double")
    joined = both.join(graph._dealt(labels.select(F.col("node").alias("other"), "label")), "other")
    assert "Broadcast" not in plan(joined) and joined.count() == 2


def test_pairs_have_as_many_tasks_as_they_call_for(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 20)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(p, f"e{(p + k) % 12:02}") for p in range(40) for k in range(5)] + [(1, "e01"), (None, "e00"), (None, "e01")]
    got = {(r.e1, r.e2): r.weight for r in graph.cooccurrence(spark.createDataFrame(rows, "place int, entity string"), ["place"]).collect()}
    want = {}
    for p in range(40):
        here = [e for q, e in rows if q == p]
        for a in here:
            for b in here:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want and spark.conf.get("spark.sql.shuffle.partitions") == usual


def test_vectors_meet_centroids_in_bounded_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["id"])
    cut = list(stored._sliced([batch], 4096))
    assert max(b.num_rows for b in cut) * 4096 <= stored.MET and [x for b in cut for x in b["id"].to_pylist()] == list(range(1000))


def test_a_cascade_computes_no_table_until_it_is_read(spark):
    sc = spark.sparkContext
    read = sc.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(f"d{i}",) for i in range(10)], "id string")
    chunks = spark.createDataFrame([(f"d{i}-{k}", f"d{i}") for i in range(10) for k in range(3)] + [("lone", None)], "id string, document_id string").mapInArrow(counted, "id string, document_id string")
    mentions = spark.createDataFrame([(f"m{i}", "e", f"d{i}-0") for i in range(10)] + [("m", "e", None)], "id string, entity_id string, chunk_id string")
    gone = spark.createDataFrame([("d1",), ("d4",), ("d4",), ("none",), (None,)], "id string")
    sc.setJobGroup("cascade", "")
    left = store.cascade({"documents": docs, "chunks": chunks, "entity_mentions": mentions}, "documents", gone)
    jobs = sc.statusTracker().getJobIdsForGroup("cascade")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs and read.value == 0
    assert left["chunks"].count() == 25 and read.value == 31
    ids = {n: {r.id for r in d.collect()} for n, d in left.items()}
    kept = [i for i in range(10) if i not in (1, 4)]
    assert ids == {"documents": {f"d{i}" for i in kept}, "chunks": {f"d{i}-{k}" for i in kept for k in range(3)} | {"lone"}, "entity_mentions": {f"m{i}" for i in kept} | {"m"}}


def test_a_cascade_that_looks_leaves_tables_that_lose_nothing(spark):
    tables = {"documents": spark.createDataFrame([("a",), ("b",)], "id string"), "chunks": spark.createDataFrame([("a1", "a"), ("b1", "b")], "id string, document_id string"), "entity_mentions": spark.createDataFrame([("m", "e", "b1")], "id string, entity_id string, chunk_id string")}
    cut = lambda i: store.cascade(tables, "documents", spark.createDataFrame([(i,)], "id string"), look=True)
    assert {n: [r.id for r in d.collect()] for n, d in cut("a").items()} == {"documents": ["b"], "chunks": ["b1"], "entity_mentions": ["m"]}
    assert {n for n, d in cut("a").items() if d is tables[n]} == {"entity_mentions"} and not any(d is tables[n] for n, d in cut("b").items())
    assert {n for n, d in cut("none").items() if d is tables[n]} == {"chunks", "entity_mentions"}
