"""Operators against hand-made cases and plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.functions.vectors import cosine
from foliospark.operators import chunk, compress, entities, filters, graph, notes, search, store
from foliospark.operators.index import LexicalIndex, VectorIndex


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())] or [(1,)], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int")
    return df.select(column).first()[0]


def loop_chunks(words, most, overlap, least):
    out, start = [], 0
    while start < len(words):
        end = min(start + most, len(words))
        if end < len(words):
            for j in range(end, max(start, end - 50), -1):
                if words[j][-1] in ".!?;":
                    end = j + 1
                    break
        if out and end - start < least:
            break
        out.append((start, end))
        start += most - overlap
    return out


def test_word_chunks_equal_the_loop(spark):
    rng = random.Random(0)
    docs = []
    for k in range(150):
        n = rng.choice([0, 1, 50, 99, 500, 501, 520, 530, 925, 1000, rng.randrange(3000)])
        docs.append((k, [rng.choice(["a", "bb", "c.", "d!", "e"]) if rng.random() < 0.3 else "w" for _ in range(n)]))
    df = spark.createDataFrame([(k, " \n".join(w)) for k, w in docs], "id long, text string")
    for sizes in (chunk.SMALL, chunk.STANDARD, chunk.LARGE):
        got = {}
        for r in chunk.chunk_words(df, sizes).orderBy("id", "chunk_index").collect():
            got.setdefault(r.id, []).append((r.start_word, r.end_word))
            assert r.content == " ".join(docs[r.id][1][r.start_word : r.end_word])
        for k, w in docs:
            assert got.get(k, []) == loop_chunks(w, sizes.most, sizes.overlap, sizes.least)


@pytest.mark.parametrize(("n", "stops", "want"), [(0, [], []), (50, [], [(0, 50)]), (520, [], [(0, 500)]), (530, [], [(0, 500), (425, 530)]), (1000, [], [(0, 500), (425, 925), (850, 1000)]), (1000, [500], [(0, 501)]), (1000, [460], [(0, 461)])])
def test_word_chunk_cases(spark, n, stops, want):
    words = ["w." if i in stops else "w" for i in range(n)]
    got = [(r.start_word, r.end_word) for r in chunk.chunk_words(spark.createDataFrame([(1, " ".join(words))], "id long, text string")).orderBy("chunk_index").collect()]
    assert got[: len(want)] == want


def test_long_texts_are_chunked_in_linear_time(spark):
    text = "word " * 999_999 + "end."
    got = chunk.chunk_words(spark.createDataFrame([(1, text)], "id long, text string"))
    n, last, longest = got.agg(F.count("*"), F.max("end_word"), F.max(F.length("content"))).first()
    assert (n, last, longest) == (-(-(1_000_000 - 99) // 425), 1_000_000, 2499)


def test_key_sentences_of_long_texts(spark):
    text = "Short one. " + "This is a sentence of some length, which is over fifty characters. " * 200_000 + "The last one!"
    got = spark.createDataFrame([(text,)], "t string").select(compress.key_sentences(F.col("t"))).first()[0]
    assert got.startswith("Short one. This is") and 450 < len(got) <= 500 + 10


def test_index_case(spark, tmp_path):
    docs = [(1, 0, "Der Krieg und der Frieden"), (2, 0, "la guerre et la paix, la paix"), (3, 0, "war and peace - straße œuvre")]
    chunks = spark.createDataFrame(docs, "doc_id long, chunk_index int, content string")
    assert chunks.where("doc_id = 3").select(text.terms(F.col("content"))).first()[0] == ["war", "and", "peace", "stra", "uvre"]
    queries = spark.createDataFrame([(0, "paix"), (1, "la paix paix"), (2, "der krieg")], "query_id int, text string")
    want = {(0, 2): pytest.approx(1.302664), (1, 2): pytest.approx(4.149226), (2, 1): pytest.approx(2.491911)}
    index = LexicalIndex.build(chunks, ["doc_id", "chunk_index"], f"file://{tmp_path}/index")
    found = lambda: {(r.query_id, r.doc_id): r.score for r in index.search(queries).collect()}
    assert found() == want
    LexicalIndex.FEW, few = 1, LexicalIndex.FEW
    assert found() == want
    LexicalIndex.FEW = few
    # Added, replaced and deleted chunks count at once, and an index that is opened anew is the same.
    more = spark.createDataFrame([(4, 0, "paix paix"), (1, 0, "nothing")], "doc_id long, chunk_index int, content string")
    index.add(more)
    fresh = LexicalIndex.build(chunks.where("doc_id > 1").union(more), ["doc_id", "chunk_index"], f"file://{tmp_path}/fresh")
    again = LexicalIndex(spark, f"file://{tmp_path}/index", ["doc_id", "chunk_index"])
    rows = lambda i: sorted(map(tuple, i.search(queries).collect()))
    assert rows(again) == rows(fresh) and {r[1] for r in rows(again)} == {2, 4}
    index.delete(spark.createDataFrame([(4,), (1,)], "doc_id long"))
    index.add(chunks.where("doc_id = 1"))
    assert found() == want
    index.clear()
    assert found() == {} and index.terms().count() == 0
    index.add(chunks)
    assert found() == want


def test_stored_vectors(spark, tmp_path):
    schema = "doc_id long, chunk_index int, embedding array<double>"
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 1.0]), (3, 0, [1.0]), (4, 0, None), (5, 0, [float("nan"), 1.0])]
    path = f"file://{tmp_path}/vectors"
    index = VectorIndex.build(spark.createDataFrame(rows, schema), ["doc_id", "chunk_index"], path, 2)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<double>")
    found = lambda: [(r.doc_id, r.chunk_index, r.score) for r in VectorIndex(spark, path, index.keys, 2).exact(asked, 2).orderBy("rank").collect()]
    assert index.vectors.count() == 3 and found() == [(1, 0, 1.0), (2, 0, 0.707107)]
    index.add(spark.createDataFrame([(1, 0, [0.0, 1.0]), (6, 0, [5.0, 0.0])], schema))
    assert index.vectors.count() == 4 and found() == [(6, 0, 1.0), (2, 0, 0.707107)]
    index.delete(spark.createDataFrame([(6,), (2,)], "doc_id long"))
    assert found() == [(1, 0, 0.0), (1, 1, 0.0)]
    index.clear()
    assert found() == []
    with pytest.raises(ValueError):
        VectorIndex(spark, f"file://{tmp_path}/none", index.keys, 2).search(asked)


@pytest.mark.parametrize("most", [1, search.QUERIES])
def test_nearest_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(search, "QUERIES", most)
    monkeypatch.setattr(search, "VECTORS", 20)
    rng = random.Random(0)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0]), (63, [float("nan")] * 4), (64, [1.0, 2.0, 3.0, 4.0]), (65, [2.0, 4.0, 6.0, 8.0])]
    asked = [(0, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [5.0])]

    def cosine(a, b):
        if b is None or len(a) != len(b) or any(x != x for x in b) or not any(b):
            return 0.0
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)

    want = {(q, r, i, s) for q, v in asked for r, (s, i) in enumerate(sorted(((cosine(v, w), i) for i, w in rows), key=lambda x: (-x[0], x[1]))[:7])}
    got = search.exact_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id int, query array<double>"), 7)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want


def test_greedy_dedup_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(q, k, " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(0, 12)))) for q in range(8) for k in range(25)]
    want = set()
    for q in range(8):
        kept = []
        for _, k, t in (r for r in rows if r[0] == q):
            w = set(t.split(" "))
            if not any(len(w & o) / len(w | o) > 0.5 for o in kept):
                kept.append(w)
                want.add((q, k))
    df = spark.createDataFrame(rows, "query_id int, rank int, content string").orderBy(F.rand(1))
    got = compress.without_near_duplicates(df, ["query_id"], "rank", 0.5)
    assert {(r.query_id, r["rank"]) for r in got.collect()} == want


def test_upserts_and_inserts_keep_their_order(spark):
    schema = "id string, name string, place int"
    old = spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], schema)
    new = spark.createDataFrame([("a", "2", 2), ("a", "9", 9), ("a", "3", 3), ("c", "1", 1), ("c", "0", 0)], schema)
    rows = lambda df: sorted((r.id, r.name) for r in df.collect())
    assert rows(store.upsert(old, new, order="place")) == [("a", "9"), ("b", "old"), ("c", "1")]
    assert rows(store.upsert(old, new)) == [("a", "3"), ("b", "old"), ("c", "0")]
    assert rows(store.insert_absent(old, new, order="place")) == [("a", "old"), ("b", "old"), ("c", "0")]
    assert rows(store.insert_absent(old, new)) == [("a", "old"), ("b", "old"), ("c", "1")]


def test_fusion_case(spark):
    rank = lambda names: spark.createDataFrame([(0, n, i) for i, n in enumerate(names)], "query_id int, c string, rank int")
    dense, sparse = rank("AB"), rank("CDA")
    got = {r.c: r.score for r in search.fuse(dense, sparse, ["c"]).collect()}
    assert got["A"] == pytest.approx(0.016185, abs=1e-6) and got["B"] == pytest.approx(0.009677, abs=1e-6) and got["C"] == pytest.approx(0.006557, abs=1e-6)
    contents = spark.createDataFrame([(c, "has KEYWORD" if c == "A" else "") for c in "ABCD"], "c string, content string")
    best = search.hybrid(dense, sparse, contents, spark.createDataFrame([(0, "keyword")], "query_id int, text string"), ["c"]).orderBy("rank").first()
    assert best.c == "A" and best.score == pytest.approx(0.032371, abs=1e-6)


def test_cosine_cases(spark):
    v = lambda a, b: round(one(spark, cosine(F.col("a"), F.col("b")), a=a, b=b), 6)
    assert v([1.0, 2.0], [3.0, 4.0]) == 0.98387
    assert v([0.0, 0.0], [3.0, 4.0]) == 0 and v([1.0], [3.0, 4.0]) == 0
    df = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 1.0],), ([1.0],)], "embedding array<double>")
    assert search.valid_vectors(df, 2).count() == 1


def test_budget_cases(spark):
    for lengths, want in (([12000, 12000, 5000, 100], [12000, 12000, 1003]), ([12000, 12900, 5000], [12000, 12900]), ([26000], [25003])):
        rows = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate(lengths)], "q int, rank int, content string")
        assert [len(r.content) for r in compress.within_budget(rows, ["q"], ["rank"]).orderBy("rank").collect()] == want


def test_near_duplicates_are_found_in_order(spark):
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[:10]), " ".join(words[:9] + ["z"])]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "q int, rank int, content string")
    assert sorted(r["rank"] for r in compress.without_near_duplicates(rows, ["q"], "rank").collect()) == [0, 2, 3]
    full = spark.createDataFrame([(0, i, f"s{i}. " * 2000) for i in range(6)], "q int, rank int, content string")
    got = compress.compress(full, ["q"], "rank").collect()
    assert {r.level for r in got} == {"aggressive"} and all(len(r.content) <= 700 for r in got)


def test_html_and_markdown_cases(spark):
    html = '<html><head><title> A &amp; B </title><style>p{}</style><script>var t="</p>";</script></head><body><p>x&nbsp;&amp;lt;y&gt;</p><!-- c > d --></body></html>'
    assert one(spark, text.html_to_text(F.col("h")), h=html) == "A & B x <y> d -->"
    assert one(spark, text.html_title(F.col("h")), h=html) == "A &amp; B"
    assert one(spark, text.markdown_to_text(F.col("m")), m="![alt](u)") == "!alt"
    assert one(spark, text.markdown_to_text(F.col("m")), m="---\na: b\n---\n# T\n- **x** *y* ~~z~~ [l](u)\n\n\n\n> q") == "T\nx y z l\nq"


def test_names(spark):
    assert one(spark, text.normal_name(F.col("n")), n="Émile  Zola") == "emile zola"
    assert one(spark, text.entity_id(F.lit("PERSON"), F.col("n")), n="Émile  Zola") == "dd502097b5df7417e4207a9e2e333fa1"
    assert one(spark, text.normal_name(F.col("n")), n="Œuvre de Große") == "uvre de groe"
    assert one(spark, text.entity_type(F.col("n")), n=" lieu ") == "LOCATION" and one(spark, text.entity_type(F.col("n")), n="thing") is None


def test_model_answers(spark):
    schema = "struct<name:string,type:string>"
    whole = 'Sure: [{"name": "A", "type": "PER"}] done'
    lines = '{"name": "A"}\nnot\n{"name": "B"}'
    got = [[x.name for x in one(spark, text.first_json_array(F.col("t"), schema), t=t)] for t in (whole, lines, "none")]
    assert got == [["A"], ["A", "B"], []]
    step = one(spark, text.agent_step(F.col("t")), t='x {"thought": "t", "action": "search", "action_input": "q"} y')
    assert (step.thought, step.action, step.action_input) == ("t", "search", "q")
    assert one(spark, text.agent_step(F.col("t")), t="plain").answer == "plain"


def test_entities_with_a_model(spark):
    chunks = spark.createDataFrame([(1, "text")], "id int, content string")
    answer = '[{"name":"Émile Zola","type":"PERSONNE","context":""},{"name":"x","type":"thing"},{"name":"","type":"PER"}]'
    got = entities.extract_with_model(chunks, ["id"], lambda c: F.concat(F.lit(answer), F.substring(c, 1, 0))).collect()
    assert [(r.name, r.type, r.context) for r in got] == [("Émile Zola", "PERSON", "Émile Zola")]


def test_entities_of_documents_in_one_plan(spark):
    pad = lambda t: t + " " + "." * 100
    chunks = spark.createDataFrame([(1, 0, pad("Anna met Bern")), (1, 1, pad("the émile zola")), (1, 2, pad("none")), (1, 3, pad("skipped")), (1, 5, pad("alone")), (2, 0, pad("known")), (3, 0, pad("fails")), (4, 0, "short")], "doc_id long, chunk_index int, content string")
    documents, known = chunks.select("doc_id").distinct(), spark.createDataFrame([(2,)], "doc_id long")

    asked = set()

    def ask(text):
        assert text.startswith("Find the persons")
        text = text.split("Text:\n", 1)[1]
        if "fails" in text or "known" in text or "skipped" in text:
            raise ValueError
        if text.startswith("alone"):
            if text not in asked:
                asked.add(text)
                raise TimeoutError
            return '[{"name": "emile zola", "type": "PER"}, {"name": "Elbe", "type": "place", "mention_text": "not there"}]'
        assert text.startswith("[Section 1]\nAnna") and "\n\n[Section 2]\nthe" in text
        return '[{"name": "Émile Zola", "type": "person"}, {"name": "EMILE ZOLA", "type": "PERSON", "mention_text": "Émile Zola"}, {"name": "Anna", "type": "PER"}]'

    found, mentions = entities.process(documents, chunks, known, entities.asking(ask), "en")
    ids = {r.entity_id: r.name for r in found.collect()}
    assert sorted(ids.values()) == ["Anna", "EMILE ZOLA", "Elbe"]
    got = sorted((ids[r.entity_id], r.doc_id, r.chunk_index) for r in mentions.collect())
    assert got == [("Anna", 1, 0), ("EMILE ZOLA", 1, 1), ("EMILE ZOLA", 1, 1), ("EMILE ZOLA", 1, 5), ("Elbe", 1, 5)]


def test_sampling_case(spark):
    rows = spark.createDataFrame([(1, i, "x" * (50 if i == 1 else 200)) for i in range(12)], "doc_id int, chunk_index int, content string")
    assert sorted(r.chunk_index for r in entities.sample(rows).collect()) == [0, 2, 5, 10]


def test_graph_cases(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "B")], "id long, title string")
    m = spark.createDataFrame([(1, 0, "e1")] * 2 + [(1, 0, "e2")] * 3, "document long, chunk int, entity string")
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (1, None)], "source long, note_id long")
    nodes, edges = graph.build(docs, m, None, links)
    got = {(r.a, r.b): (r.kind, r.weight) for r in edges.collect()}
    assert got[("entity:e1", "entity:e2")] == ("co-occurrence", 6)
    assert {k for k, v in got.items() if v[0] == "link"} == {("doc:1", "doc:1"), ("doc:1", "doc:2")}
    assert nodes.count() == 4


def test_traversal_cases(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("x", "y")], "a string, b string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert {r.node for r in graph.reachable(edges, starts, 1).collect()} == {"a", "b", "e"}
    near, links = graph.neighbourhood(edges, "a", 1, 2)
    assert near.count() == 2 and links.count() == 2
    # Only edges by which nodes are found: b-c joins two that a has found already.
    more = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "b")], "a string, b string")
    near, links = graph.neighbourhood(more, "a", 1)
    assert {tuple(r) for r in links.collect()} == {("a", "b"), ("a", "c")} and links.columns == ["a", "b"]
    assert {tuple(r) for r in graph.neighbourhood(more, "a", 2)[1].collect()} == {("a", "b"), ("a", "c"), ("d", "b")}
    pairs = spark.createDataFrame([("a", "d"), ("a", "x"), ("a", "a")], "start string, target string")
    assert {(r.start, r.target): (r.length, r.path) for r in graph.shortest_paths(edges, pairs).collect()} == {("a", "d"): (3, ["a", "b", "c", "d"]), ("a", "a"): (0, ["a"])}


def test_paths_have_no_longest_length(spark, tmp_path):
    from foliospark.plans import q_graph

    rows = [(f"n{i:02}", f"n{i + 1:02}") for i in range(21)] + [("n00", "m"), ("x", "y")]
    edges = spark.createDataFrame(rows, "a string, b string")
    pairs = spark.createDataFrame([("n00", "n21"), ("n03", "n05"), ("n00", "x"), ("y", "x"), ("m", "m")], "start string, target string")
    got = {(r.start, r.target): r.path for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {("n00", "n21"): [f"n{i:02}" for i in range(22)], ("n03", "n05"): ["n03", "n04", "n05"], ("y", "x"): ["y", "x"], ("m", "m"): ["m"]}
    # Pages 0, 2, 3, 4, 5, 1 in a chain, each sharing a word with the next: ten steps from page 0 to page 1.
    chain = [0, 2, 3, 4, 5, 1]
    words = {p: [w for w in (k - 1, k) if 0 <= w < 5] for k, p in enumerate(chain)}
    html = [(p, f"u{p}", "".join(f'<a href="/w{w}">w{w}</a>' for w in ws)) for p, ws in words.items()]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in q_graph.shortest_path(spark, str(tmp_path)).collect()}
    assert got == {("p0", "p1", 10), ("p0", "ww0", 1), ("p0", "p2", 2), ("p0", "ww1", 3), ("p0", "p3", 4)}


def test_paths_equal_a_plain_search(spark):
    """The first in order of the shortest paths, of many pairs with starts in common, with and without a depth."""
    import random
    from collections import deque

    rng = random.Random(3)
    names = [f"n{i:02}" for i in range(40)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(50)] + [("n01", "n01"), ("n01", "n02"), ("n02", "n01")]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def plain(s, t, depth):
        best, queue = {s: [s]}, deque([s])
        while queue:  # neighbours in order: the first path to reach a node is the first in order of the shortest
            x = queue.popleft()
            for y in sorted(near.get(x, ())):
                if y not in best:
                    best[y] = best[x] + [y]
                    queue.append(y)
        return best[t] if t in best and (depth is None or len(best[t]) - 1 <= depth) else None

    wanted = [(rng.choice(names[:6]), rng.choice(names)) for _ in range(60)] + [("n00", "n00"), ("gone", "gone"), ("gone", "n00"), (None, "n00"), ("n00", None)]
    edges, pairs = spark.createDataFrame(links, "a string, b string"), spark.createDataFrame(wanted, "start string, target string")
    for depth in (None, 3, 0):
        got = {(r.start, r.target): (r.length, r.path) for r in graph.shortest_paths(edges, pairs, depth).collect()}
        want = {(s, t): plain(s, t, depth) for s, t in wanted if s and t}
        assert got == {k: (len(p) - 1, p) for k, p in want.items() if p}
    assert graph.shortest_paths(edges, pairs.limit(0)).count() == 0 and graph.shortest_paths(edges.limit(0), pairs).count() == 2


def test_many_targets_on_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)], "a string, b string")
    pairs = spark.createDataFrame([("n00", f"n{i:02}") for i in range(11, 41)], "start string, target string")
    got = {r.target: r.path for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {f"n{i:02}": [f"n{j:02}" for j in range(i + 1)] for i in range(11, 41)}


def test_trees_report_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("own", "own")]
    got = {(r.key, r.root, r.depth, r.path) for r in graph.tree(spark.createDataFrame(rows, "key string, parent string")).collect()}
    assert got == {("a", "a", 0, "a"), ("b", "a", 1, "a/b"), ("c", "a", 2, "a/b/c")} | {(k, None, None, None) for k in ("x", "y", "z", "own")}


def test_communities_split_two_cliques(spark):
    rows = [(f"{s}{i}", f"{s}{j}", 1) for s in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 1)]
    edges = spark.createDataFrame(rows, "a string, b string, weight int")
    found = graph.communities(edges)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.node[0])
    assert sorted(map(sorted, groups.values())) == [["x"], ["y"]]
    assert graph.modularity(edges, found) > 0.4


def test_communities_by_brute_force(spark):
    rng = random.Random(3)
    # Four planted groups, a node that hangs on one of them, a pair of its own, a loop and a repeated edge.
    group = {f"n{i:02}": i % 4 for i in range(32)}
    rows = [(x, y, 1 + rng.randrange(3)) for x in group for y in group if x < y and rng.random() < (0.7 if group[x] == group[y] else 0.04)]
    rows += [("n00", "z", 2), ("p", "q", 1), ("p", "p", 5), ("q", "p", 1)]
    edges = spark.createDataFrame(rows, "a string, b string, weight int")
    found = graph.communities(edges)
    of = {r.node: r.community for r in found.collect()}
    assert of.keys() == group.keys() | {"z", "p", "q"} and all(min(n for n in of if of[n] == c) == c for c in set(of.values()))
    assert all((of[x] == of[y]) == (group[x] == group[y]) for x in group for y in group) and of["z"] == of["n00"] and of["p"] == of["q"] == "p"
    plain = [(x, y, w) for x, y, w in rows if x != y]
    total, degree = sum(w for *_, w in plain), {}
    for x, y, w in plain:
        degree[x], degree[y] = degree.get(x, 0) + w, degree.get(y, 0) + w

    def quality(of):
        held = {}
        for n, k in degree.items():
            held[of[n]] = held.get(of[n], 0) + k
        return sum(w for x, y, w in plain if of[x] == of[y]) / total - sum((k / (2 * total)) ** 2 for k in held.values())

    assert graph.modularity(edges, found) == pytest.approx(quality(of))
    # No node alone could go elsewhere and gain.
    assert all(quality(of | {n: c}) <= quality(of) + 1e-9 for n in of for c in set(of.values()))
    assert graph.communities(edges.where("a = 'p'")).count() == 0


def test_graph_flags_and_statistics(spark):
    docs = spark.createDataFrame([(1, "A", "book"), (2, "B", "obsidian-note"), (3, "C", "book")], "id long, title string, source_type string")
    m = spark.createDataFrame([(1, 0, "e1"), (1, 0, "e2"), (2, 0, "e1")], "document long, chunk int, entity string")
    tags = spark.createDataFrame([(2, "t")], "document long, tag string")
    links = spark.createDataFrame([(2, 1)], "source long, note_id long")
    kinds = lambda df: sorted(r.kind for r in df.collect())
    nodes, edges = graph.build(docs, m, tags, links)
    assert kinds(nodes) == ["document", "document", "entity", "entity", "note", "tag"]
    assert kinds(edges) == ["co-occurrence", "link", "mention", "mention", "mention", "tag"]
    r = graph.statistics(nodes, edges).first()
    # The document without edges is a community beside the one or more of the others.
    assert (r.entities, r.documents, r.relations) == (2, 3, 6) and 2 <= r.communities <= 4
    nodes, edges = graph.build(docs, m, with_documents=False)
    assert kinds(nodes) == ["entity", "entity"] and kinds(edges) == ["co-occurrence"] and graph.statistics(nodes, edges).first().communities == 0
    nodes, edges = graph.build(docs, m, with_entities=False)
    assert kinds(nodes) == ["document", "document", "note"] and kinds(edges) == []
    assert kinds(graph.build(docs, m, None, links, with_entities=False)[1]) == ["link"]


def test_links_resolve_in_three_ways(spark):
    notes_ = spark.createDataFrame([(1, "f/a.md", "Alpha"), (2, "b.md", "f/a")], "id long, relative_path string, title string")
    links = spark.createDataFrame([(9, "f/a"), (9, "b.md"), (9, "Alpha"), (9, "none")], "source long, target string")
    got = {(r.target, r.note_id) for r in graph.resolve_links(links, notes_).collect()}
    assert got == {("f/a", 1), ("f/a", 2), ("b.md", 2), ("Alpha", 1), ("none", None)}


NOTE = """---
title: "Given"
tags: [A, "#b"]
list:
  - x
  - y
---

# Heading
See [[Folder/Target#Sec|shown]] and [[#Only]] and [[ ]] #tag/sub text #a
## Sub
"""


def test_notes(spark):
    df = spark.createDataFrame([("d/n.md", NOTE), ("Folder/Target.md", "# Own\nback to [[d/n]]"), ("e.md", "plain")], "relative_path string, body string")
    got = {r.relative_path: r for r in notes.parse(df).collect()}
    n = got["d/n.md"]
    assert n.title == "Given" and got["Folder/Target.md"].title == "Own" and got["e.md"].title == "e"
    assert n.tags == ["A", "b", "tag/sub"] and n.frontmatter["list"] == "x, y"
    assert [(x.target, x.heading, x.display) for x in n.wikilinks] == [("Folder/Target", "Sec", "shown"), ("", "Only", None)]
    assert [(h.level, h.text) for h in n.headings] == [(1, "Heading"), (2, "Sub")]
    assert [n.text[x.start : x.end] for x in n.wikilinks] == ["[[Folder/Target#Sec|shown]]", "[[#Only]]"]
    assert [n.text[h.start :].split("\n")[0] for h in n.headings] == ["# Heading", "## Sub"]
    assert got["e.md"].wikilinks == [] and got["e.md"].headings == [] and got["e.md"].tags == []
    assert {(r.id, r.source) for r in notes.backlinks(notes.parse(df)).collect()} == {(n.id, got["Folder/Target.md"].id), (got["Folder/Target.md"].id, n.id)}


def test_page_and_section_chunks(spark):
    pages = spark.createDataFrame([(1, 1, "One two. " * 150), (1, 2, "Three four. " * 150), (2, 1, "short")], "id int, page_number int, text string")
    got = chunk.chunk_pages(pages, chunk.ChunkSizes(200, 20, 10)).orderBy("id", "chunk_index").collect()
    assert {r.id for r in got} == {1} and all(len(r.content.split()) <= 200 for r in got)
    assert got[0].page_number == 1 and got[-1].page_number == 2
    # Cuts under the least words are left out; the first chunk is page 1's, whatever the first page's number.
    opening, rest = "a" * 30 + ".", "b " * 6 + "c " * 9
    two = spark.createDataFrame([(1, 7, f"{opening} {rest}"), (1, 8, "d " * 5), (2, 5, "x " * 12)], "id int, page_number int, text string")
    got = [(r.id, r.chunk_index, r.page_number, r.content) for r in chunk.chunk_pages(two, chunk.ChunkSizes(10, 2, 3)).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, 7, f"{opening} {rest.strip()}"), (1, 1, 7, "c c d d d d d"), (2, 0, 1, " ".join("x" * 10)), (2, 1, 5, "x x x x")]
    body = "intro\n# A\n" + "Sentence here. " * 300 + "\n# B\ntail"
    rows = chunk.chunk_sections(spark.createDataFrame([(1, body), (2, None)], "id int, body string")).orderBy("chunk_index").collect()
    assert rows[0].content == "intro" and rows[-1].section_title == "B" and len(rows) > 3
    assert all(body[r.start_position : r.end_position].strip() == r.content and len(r.content) <= 2000 for r in rows)
    parts = chunk.split_for_model(spark.createDataFrame([(1, "Word. " * 1000)], "id int, text string")).orderBy("part").collect()
    assert "".join(p.content for p in parts) == "Word. " * 1000 and all(len(p.content) <= 2000 for p in parts)


def test_filters(spark):
    df = spark.createDataFrame([(1, ["#Alpha", "b"], {"k": "Value"}, [("Ann", "Lee")]), (2, None, None, None)], "id int, tags array<string>, front map<string,string>, creators array<struct<first:string,last:string>>")
    ids = lambda c: [r.id for r in df.where(c).collect()]
    assert ids(filters.tagged(F.col("tags"), ["alpha"])) == [1] and ids(filters.among(F.col("id"), [])) == [1, 2]
    assert ids(filters.front_matter_has(F.col("front"), "k", "val")) == [1] and ids(filters.front_matter_has(F.col("front"), "z")) == []
    assert ids(filters.author_is(F.lit(None).cast("string"), F.col("creators"), "ann l")) == [1]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    doc = lambda i, title: spark.createDataFrame([(i, title)], "id string, title string").select("id", "title", *[F.lit(None).cast(t).alias(c) for c, t in spark.createDataFrame([], store.SCHEMAS["documents"]).dtypes if c not in ("id", "title")])
    fill = lambda name, rows, names: spark.createDataFrame(rows, names).select("*", *[F.lit(None).cast(t).alias(c) for c, t in spark.createDataFrame([], store.SCHEMAS[name]).dtypes if c not in [x.split()[0] for x in names.split(", ")]])
    s.add_documents(doc("d1", "one").union(doc("d2", "")))
    assert {r.id: r.title for r in s.read("documents").collect()} == {"d1": "one", "d2": None}
    s.add_chunks(fill("chunks", [("d1-0", "d1"), ("d2-0", "d2")], "id string, document_id string"))
    s.add_entities(fill("entities", [("e1", "First")], "id string, name string"), fill("entity_mentions", [("m1", "e1", "d1-0"), ("m2", "e1", "d2-0")], "id string, entity_id string, chunk_id string"))
    s.add_entities(fill("entities", [("e1", "Second"), ("e2", "Other")], "id string, name string"), fill("entity_mentions", [], "id string, entity_id string, chunk_id string"))
    assert {r.id: r.name for r in s.read("entities").collect()} == {"e1": "First", "e2": "Other"}
    with pytest.raises(ValueError):
        s.add_entities(fill("entities", [], "id string, name string"), fill("entity_mentions", [("m3", "e1", "none")], "id string, entity_id string, chunk_id string"))
    s.add_documents(doc("d1", "again"))
    assert [r.id for r in s.read("chunks").collect()] == ["d2-0"] and [r.id for r in s.read("entity_mentions").collect()] == ["m2"]
    s.purge()
    assert all(s.read(n).isEmpty() for n in store.SCHEMAS)


def filled(spark, name, rows, names):
    given = [x.split()[0] for x in names.split(", ")]
    return spark.createDataFrame(rows, names).select("*", *[F.lit(None).cast(t).alias(c) for c, t in spark.createDataFrame([], store.SCHEMAS[name]).dtypes if c not in given])


def test_a_change_of_several_tables_is_one_commit(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    docs = lambda *rows: filled(spark, "documents", rows, "id string, title string")
    chunks = lambda *rows: filled(spark, "chunks", rows, "id string, document_id string")
    s.add_documents(docs(("a", "A"), ("b", "B"), ("b", "B2")))
    s.add_chunks(chunks(("a1", "a"), ("b1", "b")))
    held = s.read_all()
    ids = lambda name: sorted(r.id for r in s.read(name).collect())
    number = s.commits.newest()[0]
    s.add_documents(docs(("a", "A2")))
    assert s.commits.newest()[0] == number + 1 and ids("chunks") == ["b1"]
    # Who began before still reads what was there.
    assert {r.id for r in held["chunks"].collect()} == {"a1", "b1"} and {r.title for r in held["documents"].collect()} == {"A", "B2"}
    # A writer that fails between two tables changes nothing.
    s.add_chunks(chunks(("a2", "a")))
    before = {n: sorted(map(str, d.collect())) for n, d in s.read_all().items()}
    typed, seen = s._typed, []

    def failing(name, df):
        seen.append(name)
        if len(seen) == 2:
            raise OSError("disk full")
        return typed(name, df)

    s._typed = failing
    with pytest.raises(OSError):
        s.add_documents(docs(("a", "A3")))
    s._typed = typed
    assert len(seen) == 2 and {n: sorted(map(str, d.collect())) for n, d in s.read_all().items()} == before
    # New ids add files; nothing is written again.
    tables = s.commits.newest()[1]["tables"]
    s.add_documents(docs(("c", "C")))
    after = s.commits.newest()[1]["tables"]
    assert after["documents"][:-1] == tables["documents"] and after["chunks"] == tables["chunks"]
    # Of two writers that began with one state the second is told.
    stale = s._now()
    s.append("documents", docs(("d", "D")))
    with pytest.raises(store.Changed):
        s._commit(*stale, {"documents": docs(("z", "Z"))})
    assert ids("documents") == ["a", "b", "c", "d"]
    # Lookups by id, path and hash.
    s.write("documents", filled(spark, "documents", [("x", "/p/x.md", "h1"), ("y", "/p/y.md", "h2")], "id string, file_path string, file_hash string"))
    assert [s.get("documents", v, c).first().id for v, c in (("x", "id"), ("/p/y.md", "file_path"), ("h2", "file_hash"))] == ["x", "y", "y"]


def test_links_of_notes_without_links_go(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    links = lambda *rows: filled(spark, "vault_links", rows, "source_note_id string, target_relative_path string")
    s.replace_links(links(("n1", "a.md"), ("n1", "b.md"), ("n2", "a.md"), ("n3", "c.md")))
    s.replace_links(links(("n1", "z.md")), spark.createDataFrame([("n1",), ("n2",)], "id string"))
    assert sorted((r.source_note_id, r.target_relative_path) for r in s.read("vault_links").collect()) == [("n1", "z.md"), ("n3", "c.md")]
