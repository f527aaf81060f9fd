"""Queries on documents, conversations, events and store semantics."""

from pyspark.sql import functions as F

from ..functions.text import WS, citation, export_name, html_title, html_to_text, jaccard, markdown_to_text, short_title, snippet
from ..operators import compress, filters, search, store
from ..streaming import events as ev
from .q_retrieval import BM25_SQL, HYBRID_SQL, _questions, hybrid_hits
from .registry import query
from .views import CHUNKS_SQL, KEYS, chunks, documents, index, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("ingest_dedup_hash", "SELECT doc_id, sha256(text) AS file_hash, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS ingested FROM documents")
def ingest_dedup_hash(spark, sf_dir):
    """Of documents with one content the first is ingested."""
    d = _docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    first = d.groupBy("file_hash").agg(F.min("doc_id").alias("first"))
    return d.join(first, "file_hash").select("doc_id", "file_hash", (F.col("doc_id") == F.col("first")).alias("ingested"))


@query("incremental_skip", "SELECT a.page_id FROM pages a WHERE NOT EXISTS (SELECT 1 FROM pages b WHERE b.page_id % 2 = 0 AND sha256(b.html) = sha256(a.html))")
def incremental_skip(spark, sf_dir):
    """Pages whose content was not yet among those of even numbers."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("h"))
    return p.join(p.where("page_id % 2 = 0").select("h"), "h", "left_anti").select("page_id")


@query("stats_overview", f"WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM documents)::BIGINT AS document_count, (SELECT count(*) FROM chunks)::BIGINT AS chunk_count, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL)::BIGINT AS embedding_count, (SELECT count(*) FROM pages)::BIGINT AS note_count, (SELECT count(DISTINCT conv_id) FROM conversations)::BIGINT AS session_count")
def stats_overview(spark, sf_dir):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    s = table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("session_count"))
    return one(_docs(spark, sf_dir), "document_count").crossJoin(one(chunks(spark, sf_dir), "chunk_count")).crossJoin(one(e, "embedding_count")).crossJoin(one(table(spark, sf_dir, "pages"), "note_count")).crossJoin(s)


@query("docs_by_source", "SELECT source AS source_type, count(*)::BIGINT AS n, max(doc_id) AS last_indexed FROM documents GROUP BY source")
def docs_by_source(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"), F.max("id").alias("last_indexed"))


@query("languages", "SELECT DISTINCT lang AS language FROM documents WHERE lang IS NOT NULL")
def languages(spark, sf_dir):
    return documents(spark, sf_dir).where("language is not null").select("language").distinct()


@query("recent_docs", f"WITH {CHUNKS_SQL}, r AS (SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 20) SELECT r.doc_id, source AS source_type, substr(content, 1, 300) AS excerpt FROM r LEFT JOIN chunks c ON c.doc_id = r.doc_id AND c.chunk_index = 0")
def recent_docs(spark, sf_dir):
    recent = documents(spark, sf_dir).orderBy(F.desc("id")).limit(20).select(F.col("id").alias("doc_id"), "source_type")
    first = chunks(spark, sf_dir).join(recent.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("content", "chunk_index").alias("content"))
    return recent.join(first, "doc_id", "left").select("doc_id", "source_type", F.substring("content", 1, 300).alias("excerpt"))


@query("documents_by_recency", "SELECT doc_id, nullif(source, '') AS source_type, nullif(lang, '') AS language, sha256(text) AS file_hash FROM documents")
def documents_by_recency(spark, sf_dir):
    d = store.empty_to_null(_docs(spark, sf_dir).select("doc_id", F.col("source").alias("source_type"), F.col("lang").alias("language"), "text"))
    return d.select("doc_id", "source_type", "language", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash")).orderBy(F.desc("doc_id"))


@query("jaccard_pairs", r"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents), p AS (SELECT a.doc_id, len(a.w) AS x, len(b.w) AS y, len(list_intersect(a.w, b.w)) AS c FROM w a JOIN w b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(c::DOUBLE / (x + y - c), 6) AS similarity FROM p""")
def jaccard_pairs(spark, sf_dir):
    """Of each document and the next."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return d.join(n, "doc_id").select("doc_id", F.round(jaccard(F.col("text"), F.col("next")), 6).alias("similarity"))


@query(
    "context_budget",
    f"""WITH {CHUNKS_SQL}, b AS (SELECT doc_id, chunk_index, length(content) AS n, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks),
    f AS (SELECT *, before + n <= 10000 AS fits, coalesce(bool_and(before + n <= 10000) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS first FROM b)
    SELECT doc_id, chunk_index, (CASE WHEN fits THEN n ELSE 10000 - before + 3 END)::INTEGER AS n_chars FROM f WHERE fits OR (first AND 10000 - before > 200)""",
)
def context_budget(spark, sf_dir):
    """Each document's chunks as a context of at most 10,000 characters."""
    kept = compress.within_budget(chunks(spark, sf_dir).select(*KEYS, "content"), ["doc_id"], ["chunk_index"], 10_000)
    return kept.select(*KEYS, F.length("content").alias("n_chars"))


@query("context_level", f"WITH {CHUNKS_SQL} SELECT doc_id, sum(length(content))::BIGINT AS n_chars, CASE WHEN sum(length(content)) > 30000 THEN 'aggressive' WHEN sum(length(content)) > 15000 THEN 'medium' ELSE 'none' END AS level, floor(least(100, 100 * 25000::DOUBLE / sum(length(content))) + 0.5)::BIGINT AS kept_percent FROM chunks GROUP BY doc_id")
def context_level(spark, sf_dir):
    t = chunks(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("content")).alias("n_chars"))
    return t.select("doc_id", "n_chars", compress.level(F.col("n_chars")).alias("level"), F.floor(F.least(F.lit(100.0), 100 * F.lit(25000.0) / F.col("n_chars")) + 0.5).alias("kept_percent"))


@query(
    "key_sentences",
    r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]+[.!?]+') AS s FROM documents),
    u AS (SELECT doc_id, len(s) AS n, i, s[i] AS raw, regexp_replace(s[i], '^\s+|\s+$', '', 'g') AS t FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s WHERE len(s) > 3)),
    o AS (SELECT *, CASE WHEN i = 1 THEN 3 WHEN i = n THEN 2 ELSE 1 END + CASE WHEN length(raw) > 50 THEN 1 ELSE 0 END AS score FROM u),
    c AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) AS run FROM o),
    k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY score DESC, i) AS kept FROM c WHERE run <= 500 GROUP BY doc_id)
    SELECT s.doc_id, md5(CASE WHEN len(s) <= 3 THEN substr(text, 1, 500) ELSE coalesce(kept, '') END) AS kept_md5 FROM s LEFT JOIN k ON k.doc_id = s.doc_id""",
)
def key_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(compress.key_sentences(F.col("text")).cast("binary")).alias("kept_md5"))


def _few(spark, sf_dir):
    """Whether hits of all questions can be sent to every task."""
    return _questions(spark, sf_dir).limit(search.QUERIES + 1).count() <= search.QUERIES


def _contexts(spark, sf_dir):
    held = index(spark, sf_dir)
    hits = held.search(_questions(spark, sf_dir), 20)
    return held.texts.select(*KEYS, "content").join(F.broadcast(hits) if _few(spark, sf_dir) else hits, KEYS).select("query_id", "rank", *KEYS, "score", "content")


@query("compressed_context")
def compressed_context(spark, sf_dir):
    """The twenty best chunks for each text of benchmark, compressed."""
    return compress.compress(_contexts(spark, sf_dir), ["query_id"], "rank").select("query_id", "rank", *KEYS, "level", F.length("content").alias("n_chars"))


@query("greedy_dedup")
def greedy_dedup(spark, sf_dir):
    """The hits that stay after near-duplicates of earlier ones are left out."""
    return compress.without_near_duplicates(_contexts(spark, sf_dir), ["query_id"], "rank").select("query_id", "rank", *KEYS)


@query("session_messages", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def session_messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5")).orderBy("conv_id", "turn")


@query("session_list", "SELECT conv_id, count(*)::BIGINT AS n_messages, max(turn) AS last_turn, CASE WHEN length(arg_min(text, turn)) > 60 THEN substr(arg_min(text, turn), 1, 57) || '...' ELSE arg_min(text, turn) END AS title FROM conversations GROUP BY conv_id")
def session_list(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.min_by("text", "turn").alias("text"))
    return s.select("conv_id", "n_messages", "last_turn", short_title(F.col("text")).alias("title"))


@query("export_conversation", "SELECT conv_id, count(*)::BIGINT AS message_count, md5(string_agg('## ' || CASE role WHEN 'user' THEN 'Question' ELSE 'Answer' END || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS body_md5 FROM conversations GROUP BY conv_id")
def export_conversation(spark, sf_dir):
    from ..sources.exports import conversation_bodies

    return conversation_bodies(table(spark, sf_dir, "conversations")).select("conv_id", "message_count", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    "export_names",
    r"""WITH s AS (SELECT doc_id, '2024-01-01-' || coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(translate(lower(substr(text, 1, 40)), 'àáâãäåèéêëìíîïòóôõöùúûüç', 'aaaaaaeeeeiiiiooooouuuuc'), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), 1, 50), '-+$', ''), ''), 'export') AS slug FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) - 1 AS k FROM s) SELECT doc_id, slug || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.md' AS file_name FROM n""",
)
def export_names(spark, sf_dir):
    """File names of exports; names already taken get a number."""
    from ..sources.exports import name_of, places

    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.regexp_replace(export_name(F.lit("2024-01-01"), F.col("title")), r"\.md\z", "").alias("stem"))
    return places(d, "stem", ["doc_id"]).select("doc_id", name_of(F.col("stem"), F.col("place")).alias("file_name"))


@query("citations", "SELECT doc_id, concat_ws(' - ', nullif(source, ''), nullif(substr(text, 1, 40), ''), '(' || nullif(lang, '') || ')', CASE WHEN doc_id % 3 > 0 THEN 'p. ' || doc_id % 3 END) AS reference FROM documents")
def citations(spark, sf_dir):
    page = F.nullif(F.col("id") % 3, F.lit(0))
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), citation(F.col("source_type"), F.col("title"), F.col("language"), page).alias("reference"))


@query(
    "snippets",
    r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s+.+$', '', 'g'), '\[\[[^\]|]+\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]|]+)\]\]', '\1', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_~`]+', '', 'g'), '\n{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS p FROM documents)
    SELECT doc_id, CASE WHEN length(p) <= 150 THEN p ELSE regexp_replace(substr(p, 1, 150), '\s[^\s]*$', '') || '...' END AS snippet FROM p""",
)
def snippets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", snippet(F.col("text")).alias("snippet"))


@query(
    "html_text",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[^>]*>[\s\S]*?</script>', '', 'g'), '(?i)<style[^>]*>[\s\S]*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""",
)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html_to_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("html_title", r"SELECT page_id, nullif(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), '^\s+|\s+$', '', 'g'), '') AS title FROM pages")
def html_title_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"))


@query(
    "markdown_text",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?m)^#{1,6}\s+', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '~~(.+?)~~', '\1', 'g'), '`(.+?)`', '\1', 'g'), '```[\s\S]*?```', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '!\[([^\]]*)\]\([^)]+\)', '', 'g'),
    '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '(?m)^\s*>\s+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""",
)
def markdown_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(markdown_to_text(F.col("text")).cast("binary")).alias("text_md5"))


@query("labelled_docs", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND source IN ('src1', 'src2', 'src3')")
def labelled_docs(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source").where(filters.among(F.col("source"), ["src1", "src2", "src3"]))
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("unlabelled_docs", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("title_or_content", f"WITH {CHUNKS_SQL} SELECT doc_id FROM documents WHERE contains(lower(substr(text, 1, 40)), 'the') UNION SELECT doc_id FROM chunks WHERE contains(lower(content), 'tion')")
def title_or_content(spark, sf_dir):
    by_title = documents(spark, sf_dir).where(filters.has(F.col("title"), "the")).select(F.col("id").alias("doc_id"))
    by_content = chunks(spark, sf_dir).where(filters.has(F.col("content"), "tion")).select("doc_id")
    return by_title.union(by_content).distinct()


@query(
    "item_filters",
    "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '00') AND contains(strftime(o_orderdate, '%Y'), '199') AND lower(o_orderpriority) IN ('1-urgent', '2-high') AND contains(lower(concat_ws(' ', c_name, c_mktsegment, o_orderstatus)), 'b')",
)
def item_filters(spark, sf_dir):
    """Orders as bibliography items: by author, year, tags and free text."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    hit = filters.author_is(F.col("c_name"), None, "00") & filters.year_is(F.date_format("o_orderdate", "yyyy"), "199") & filters.tagged(F.array("o_orderpriority"), ["#1-URGENT", "2-high"])
    return d.where(hit & filters.text_has([F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderstatus")], "b")).select("o_orderkey")


@query(
    "item_assembly",
    """SELECT o_orderkey AS item, c_name AS creator, n_name AS library, count(*)::BIGINT AS n_parts, string_agg(l_linenumber || ':' || coalesce(p_name, ''), ';' ORDER BY l_linenumber, l_partkey) AS parts
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P' GROUP BY ALL""",
)
def item_assembly(spark, sf_dir):
    """Orders as items with their creator, library and ordered parts."""
    from ..sources.bibliography import ordered_list

    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    listed = ordered_list(parts, "l_orderkey", ["l_linenumber", "l_partkey"], F.concat_ws(":", F.col("l_linenumber").cast("string"), F.coalesce("p_name", F.lit(""))))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    d = o.join(people, F.col("o_custkey") == F.col("c_custkey")).join(listed, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select(F.col("o_orderkey").alias("item"), F.col("c_name").alias("creator"), F.col("n_name").alias("library"), F.size("values").cast("long").alias("n_parts"), F.array_join("values", ";").alias("parts"))


@query("field_pivot", "SELECT l_orderkey AS item, string_agg(f || '=' || value, ',' ORDER BY f) AS fields FROM (SELECT l_orderkey, l_returnflag AS f, arg_max(l_partkey, (l_linenumber, l_partkey))::VARCHAR AS value FROM lineitem GROUP BY ALL) GROUP BY ALL")
def field_pivot(spark, sf_dir):
    """Rows of item, field and value as one map an item; of a field that comes twice the last value."""
    from ..sources.bibliography import pivot_fields

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("value"), F.struct("l_linenumber", "l_partkey").alias("place"))
    m = pivot_fields(rows, order="place")
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("item", F.array_join(pairs, ",").alias("fields"))


@query("upsert_documents", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'last' ELSE source END AS source, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS place FROM documents UNION ALL SELECT doc_id + 10000000, 'new', 0 FROM documents WHERE doc_id % 7 = 0")
def upsert_documents(spark, sf_dir):
    """Every seventh document arrives again, twice, of which the later stays, and once more under another id."""
    old = _docs(spark, sf_dir).select("doc_id", "source", F.lit(0).alias("place"))
    again = old.where("doc_id % 7 = 0")
    batch = lambda shift, source, place: again.select((F.col("doc_id") + shift).alias("doc_id"), F.lit(source).alias("source"), F.lit(place).alias("place"))
    return store.upsert(old, batch(0, "last", 2).union(batch(0, "new", 1)).union(batch(10_000_000, "new", 0)), "doc_id", "place")


@query("insert_absent", "WITH n AS (SELECT c_mktsegment AS id, min(c_name) AS name FROM customer GROUP BY ALL) SELECT * FROM n UNION ALL SELECT n_name, n_name FROM nation WHERE n_name NOT IN (SELECT id FROM n)")
def insert_absent(spark, sf_dir):
    """First come stay: of a batch the first by name, and nothing that is known already."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("name"))
    return store.insert_absent(n, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("id"), F.col("c_name").alias("name")), "id", "name")


@query("cascade_delete", f"WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM documents WHERE source <> 'src0')::BIGINT AS documents, (SELECT count(*) FROM chunks JOIN documents USING (doc_id) WHERE source <> 'src0')::BIGINT AS chunks")
def cascade_delete(spark, sf_dir):
    """What is left of documents and chunks when a source goes."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "source")
    c = chunks(spark, sf_dir).select(F.concat_ws("-", "doc_id", "chunk_index").alias("id"), F.col("doc_id").cast("string").alias("document_id"))
    m = c.select(F.col("id").alias("chunk_id"), F.col("id").alias("entity_id"), "id")
    left = store.cascade({"documents": d, "chunks": c, "entity_mentions": m}, "documents", d.where("source = 'src0'").select("id"))
    return left["documents"].agg(F.count("*").alias("documents")).crossJoin(left["chunks"].agg(F.count("*").alias("chunks")))


@query(
    "debounce_last_event",
    """WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 4 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS fresh FROM events),
    g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o) SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, count(*)::BIGINT AS n FROM g GROUP BY user_id, g""",
)
def debounce_last_event(spark, sf_dir):
    """One firing for each burst of a key's events that are under four hours apart."""
    return ev.debounce(table(spark, sf_dir, "events"), "ts", "user_id", "4 hours", "event_id").select("user_id", "last_event", "n")


@query("audit_tail", "SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("audit_counts", "SELECT event_type, count(*)::BIGINT AS n, epoch_us(max(ts))::BIGINT AS last_us FROM events GROUP BY event_type")
def audit_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last_us"))


@query(
    "search_corpus",
    f"WITH {HYBRID_SQL}, t AS (SELECT h.query_id, h.doc_id, h.chunk_index, h.score, d.source AS source_type FROM hybrid h JOIN documents d USING (doc_id) WHERE h.rank < 40), f AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) - 1)::INTEGER AS rank FROM t WHERE source_type <> 'src0' AND score >= 0.008) SELECT query_id, doc_id, chunk_index, source_type, floor(score * 1000 + 0.5) / 1000 AS similarity, rank FROM f WHERE rank < 20",
)
def search_corpus(spark, sf_dir):
    """Hybrid hits, twice as many as asked for, then filtered by type and score, then limited."""
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "source_type")
    hits = hybrid_hits(spark, sf_dir, 40).drop("rank").join(d, "doc_id").where((F.col("source_type") != "src0") & (F.col("score") >= 0.008))
    kept = search.top(hits, 20, ["query_id"], [F.desc("score"), "doc_id", "chunk_index"])
    return kept.select("query_id", *KEYS, "source_type", (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("similarity"), "rank")


@query("search_compressed")
def search_compressed(spark, sf_dir):
    """As search_corpus, with what is left compressed before the limit."""
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "source_type")
    hits = hybrid_hits(spark, sf_dir, 40).join(d, "doc_id").where((F.col("source_type") != "src0") & (F.col("score") >= 0.008))
    hits = hits.select("query_id", "rank", *KEYS, "score")
    full = index(spark, sf_dir).texts.select(*KEYS, "content").join(F.broadcast(hits) if _few(spark, sf_dir) else hits, KEYS)
    kept = compress.compress(full, ["query_id"], "rank").withColumnRenamed("rank", "place")
    return search.top(kept, 20, ["query_id"], [F.col("place")]).select("query_id", *KEYS, "level", F.md5(F.col("content").cast("binary")).alias("content_md5"), "rank")


@query("rag_prompt", f"WITH {BM25_SQL}, h AS (SELECT query_id, rank, d.source, content FROM sparse JOIN chunks USING (doc_id, chunk_index) JOIN documents d USING (doc_id) WHERE rank < 3) SELECT query_id, md5(string_agg('[Source ' || (rank + 1) || ' - ' || source || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM h GROUP BY query_id")
def rag_prompt(spark, sf_dir):
    """The numbered sources of each question's prompt."""
    from ..plans.service import numbered_sources

    held = index(spark, sf_dir)
    hits = held.search(_questions(spark, sf_dir), 3)
    full = held.texts.select(*KEYS, "content").join(F.broadcast(hits) if _few(spark, sf_dir) else hits, KEYS).join(documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("source_type").alias("reference")), "doc_id")
    return numbered_sources(full, "Source").select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query("word_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS n_words, substr(text, 1, 200) AS preview FROM documents")
def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.filter(F.split("text", f"{WS}+"), lambda w: w != "")).alias("n_words"), F.substring("text", 1, 200).alias("preview"))
