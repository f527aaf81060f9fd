"""Compositions: retrieval façade, entity context, community members, workspaces' settings."""

from pyspark.sql import functions as F

from foliospark.operators import graph
from foliospark.operators.index import LexicalIndex
from foliospark.plans import service
from foliospark.sources import workspaces


def test_find(spark, tmp_path):
    rows = [(1, 0, "the krakow archive of letters"), (2, 0, "weather and harvest reports"), (3, 0, "letters from the harvest")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")
    vectors = chunks.select("doc_id", "chunk_index", service.hash_embedding(F.col("content")).alias("embedding"))
    q = spark.createDataFrame([(0, "krakow archive")], "query_id int, text string").withColumn("query", service.hash_embedding(F.col("text")))
    index = LexicalIndex.build(chunks, ["doc_id", "chunk_index"], f"file://{tmp_path}/index")
    for lexical in (True, False):
        best = service.find(index, vectors, q, 2, lexical).orderBy("rank").collect()
        assert best[0].doc_id == 1 and len(best) == 2
    documents = spark.createDataFrame([(1, "book", "K"), (3, "note", "L")], "doc_id long, source_type string, title string")
    got = service.search_documents(index, vectors, documents, q, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.content, r.level) for r in got] == [(1, rows[0][2], "none"), (3, rows[2][2], "none")]
    assert [r.doc_id for r in service.search_documents(index, vectors, documents, q, 2, ["note"]).collect()] == [3]
    nodes = spark.createDataFrame([("n1", "The Krakow archive", "entity", 0), ("n2", "Vistula", "entity", 1), ("n3", "Elbe", "entity", 2)], "id string, label string, kind string, ord int")
    edges = spark.createDataFrame([("n1", "n2")], "a string, b string")
    found = service.search_documents(index, vectors, documents, q, 2)
    prompt = service.connections_prompt(found, q.select("query_id", "text"), nodes, edges, beyond=False).first().prompt
    assert "Only what stands in the corpus" in prompt and f"[1] (book) K\n{rows[0][2]}\n\n---\n\n[2] (note) L" in prompt
    assert "- The Krakow archive (entity)\n- Vistula (entity)\n" in prompt and "Elbe" not in prompt
    dated = found.withColumns({"author": F.lit("Ann"), "year": F.lit("")})
    assert f"[1] (book) K, Ann\n{rows[0][2]}" in service.check_prompt(dated, q.select("query_id", "text"), strict=True).first().prompt
    nothing = service.check_prompt(dated.limit(0), q.select("query_id", "text")).first().prompt
    assert "holds no evidence" in nothing and "krakow archive" in nothing
    assert vectors.first().embedding == chunks.select(service.hash_embedding(F.col("content"))).first()[0] and len(vectors.first().embedding) == 64


def test_entity_context(spark):
    m = spark.createDataFrame([(1, 0, "Anna", "x"), (1, 0, "Bern", "x"), (1, 0, "Bern", "x"), (2, 0, "Anna", "y"), (2, 1, "Carl", "z")], "doc_id long, chunk_index int, name string, excerpt string")
    d = spark.createDataFrame([(1, "one", ["a", "b"]), (2, "two", ["b"])], "doc_id long, title string, tags array<string>")
    got = service.entity_context(m, d, "ann")
    assert [(r.name, r.occurrences) for r in got["entities"].collect()] == [("Anna", 2)]
    assert {(r.doc_id, r.excerpt) for r in got["documents"].collect()} == {(1, "x"), (2, "y")}
    assert [(r.name, r.weight) for r in got["related"].collect()] == [("Bern", 2)] and [r.tag for r in got["tags"].collect()] == ["a", "b"]


def test_note_tags_of_entities(spark):
    m = spark.createDataFrame([(1, 0, "Anna", "x"), (2, 0, "Bern", "y")], "doc_id long, chunk_index int, name string, excerpt string")
    d = spark.createDataFrame([(1, "one", "a.md", ["b"]), (2, "two", "c.md", None), (3, "one", "d.md", None)], "doc_id long, title string, file_path string, tags array<string>")
    notes = spark.createDataFrame([("a.md", ["b", "n"]), ("c.md", ["other"]), ("d.md", ["z"])], "relative_path string, tags array<string>")
    assert [r.tag for r in service.entity_context(m, d, "ann", notes=notes)["tags"].collect()] == ["b", "n", "z"]


def test_counters_and_indexed_items(spark):
    state = spark.createDataFrame([("a", "ingested"), ("b", "skipped"), ("c", "unsupported"), ("d", "ingested")], "path string, status string")
    assert tuple(service.counters(state).first()) == (2, 1, 1)
    d = spark.createDataFrame(
        [(1, "War", "Ann Lee", None, "1999", None, ["#A"], ["My Coll"], "Lib"), (2, "Peace", None, [("Leo", "T")], "2001", "on war", None, None, None), (3, "Sea", None, None, None, None, None, None, None)],
        "doc_id long, title string, author string, creators array<struct<first:string,last:string>>, year string, abstract string, tags array<string>, collections array<string>, library string",
    )
    chunks = spark.createDataFrame([(1, 1, "later"), (1, 0, "x" * 400), (3, 0, "waves")], "doc_id long, chunk_index int, content string")
    ids = lambda **k: [r.doc_id for r in service.search_indexed_items(d, chunks, **k).orderBy("doc_id").collect()]
    assert ids(query="war") == [1, 2] and ids(query="war", hits=d.where("doc_id = 3")) == [1, 2, 3]
    assert ids(author="leo t") == [2] and ids(year="199") == [1] and ids(tags=["a"]) == [1] and ids(collection="coll", library="lib") == [1] and ids(limit=2) == [1, 2]
    assert [r.excerpt for r in service.search_indexed_items(d, chunks).orderBy("doc_id").collect()] == ["x" * 300, None, "waves"]


def test_explore_and_members(spark):
    nodes = spark.createDataFrame([("entity:a", "a", 0), ("entity:b", "bee", 1)], "id string, label string, ord int")
    edges = spark.createDataFrame([("entity:a", "entity:b", 1)], "a string, b string, weight int")
    assert service.explore(nodes, edges, "a")["nodes"].count() == 2
    assert service.explore(nodes, edges, "EE") == {"found": False, "suggestions": ["bee"]}
    found = spark.createDataFrame([("entity:a", "c"), ("entity:b", "c"), ("x", "d")], "node string, community string")
    members, inside = graph.community_members(edges, found, "c")
    assert members.count() == 2 and inside.count() == 1


def test_workspace_settings(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    workspaces.create(spark, folder, workspaces.Workspace("w"))
    assert workspaces.update(spark, folder, language="de").language == "de" and workspaces.load(spark, folder).language == "de"
    assert workspaces.delete(spark, folder) and not workspaces.delete(spark, folder)


def test_prompts(spark):
    hits = spark.createDataFrame([(0, 0, "Ann", "T", "1999", 3, "text"), (0, 1, None, "U", None, None, "more")], "query_id int, rank int, author string, title string, year string, page_number int, content string")
    q = spark.createDataFrame([(0, "why?")], "query_id int, text string")
    p = service.prompts(hits, q, "en").first().prompt
    assert "[Source 1 - Ann - T - (1999) - p. 3]\ntext\n\n[Source 2 - U]\nmore" in p and p.endswith("Question : why?")


def test_counters_in_the_same_pass(spark, tmp_path):
    state = spark.createDataFrame([("a", "ingested"), ("b", "skipped"), ("c", "ingested"), ("d", "unreadable")], "path string, status string")
    seen, get = service.counted(state)
    seen.write.parquet(f"{tmp_path}/state")
    assert get() == {"ingested": 2, "skipped": 1, "errors": 1}
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None)], "key string, version string")
    after = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1"), ("e", "1")], "key string, version string")
    found, get = service.sync_counted(before, after, "key", "version")
    assert {r.key: r.status for r in found.collect()} == {"a": "removed", "b": "changed", "c": "same", "d": "changed", "e": "added"}
    assert get() == {"added": 1, "changed": 2, "removed": 1, "same": 1}


def test_search_notes(spark):
    from foliospark.operators import notes

    rows = [
        ("b.md", "---\ntags: [Trade, old]\nauthor: Ann Lee\n---\n# Harbours\nShips went to [[Town#Port|the town]]."),
        ("a.md", "---\nauthor: Bob\n---\nOf ships and men #trade/sea"),
        ("c.md", "# Ships\n[[Other]]"),
        ("d.md", ""),
        ("e.md", None),
    ]
    parsed = notes.parse(spark.createDataFrame(rows, "relative_path string, body string"))
    found = lambda **how: [r.relative_path for r in service.search_notes(parsed, **how).collect()]
    # Title or body, in the order of paths.
    assert found(text="SHIPS") == ["a.md", "b.md", "c.md"] and found(text="harbours") == ["b.md"]
    assert found(tags=["old"]) == ["b.md"] and found(link="town") == ["b.md"]
    assert found(front=("author", None)) == ["a.md", "b.md"] and found(front=("author", "lee")) == ["b.md"] and found(front=("nothing", None)) == []
    assert found(text="ships", front=("author", "bob")) == ["a.md"] and found(text="ships", limit=2) == ["a.md", "b.md"]
    assert [r.links for r in service.search_notes(parsed, link="town").collect()] == [["Town"]]
    assert len(found()) == 5


def test_themes_in_labels(spark):
    labels = ["Harbour", "the harbour's BAR", "ab", "", None, "b", "Éab", "bar bar"]
    themes = ["har", "BAR", "ab", "b", "", None, "harbour", "éa", "zz"]
    nodes = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "id int, label string")
    found = service._holding(nodes, spark.createDataFrame([(k, x) for k, x in enumerate(themes)], "query_id int, text string"))
    want = sorted((q, k) for q, t in enumerate(themes) for k, x in enumerate(labels) if t is not None and x is not None and t.lower() in x.lower())
    assert sorted((r.query_id, r.id) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
