"""Compositions for callers: prompts, ingest, notes, exploration, and an agent loop with an injected model."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import citation
from ..operators import compress, filters, graph, search
from ..operators.chunk import STANDARD, ChunkSizes, chunk_words
from ..operators.index import LexicalIndex
from ..sources.files import extract

# Words of prompts by language.
LABELS = {
    "fr": {"extracts": "Voici des extraits pertinents des documents et notes indexés (triés par pertinence)", "question": "Question", "source": "Source", "note": "Note"},
    "en": {"extracts": "Here are relevant extracts from indexed documents and notes (sorted by relevance)", "question": "Question", "source": "Source", "note": "Note"},
    "de": {"extracts": "Hier sind relevante Auszüge aus indizierten Dokumenten und Notizen (nach Relevanz sortiert)", "question": "Frage", "source": "Quelle", "note": "Notiz"},
}


def numbered_sources(hits: DataFrame, label: str) -> DataFrame:
    """query_id, context of hits (query_id, rank, reference, content): numbered sources with blank lines between."""
    block = F.concat(F.lit(f"[{label} "), (F.col("rank") + 1).cast("string"), F.lit(" - "), F.col("reference"), F.lit("]\n"), F.col("content"))
    listed = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(listed.alias("s")).select("query_id", F.array_join(F.transform("s", lambda x: x["block"]), "\n\n").alias("context"))


def prompts(hits: DataFrame, questions: DataFrame, language: str = "fr") -> DataFrame:
    """query_id, prompt: header, numbered sources, question. hits (query_id, rank, author, title, year, page_number, content)."""
    words = LABELS.get(language, LABELS["fr"])
    named = hits.withColumn("reference", citation(F.col("author"), F.col("title"), F.col("year"), F.col("page_number")))
    both = numbered_sources(named, words["source"]).join(questions, "query_id")
    return both.select("query_id", F.concat(F.lit(f"{words['extracts']} :\n\n"), "context", F.lit(f"\n\n{words['question']} : "), F.col("text")).alias("prompt"))


def ingest(files: DataFrame, known: DataFrame, sizes: ChunkSizes = STANDARD, pdf: Callable | None = None, embed: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, chunks and status of files (path, content) against known (file_hash).

    Contents that are known, or come twice, are skipped; the first path wins. embed is a function from a
    column of texts to a column of vectors; where it gives none the chunk stays, without a vector.
    """
    read = extract(files, pdf)
    first = read.groupBy("file_hash").agg(F.min("path").alias("path"))
    new = read.join(first, ["file_hash", "path"], "left_semi").join(known.select("file_hash"), "file_hash", "left_anti").where("status = 'ok'")
    documents = new.select(F.md5(F.col("path").cast("binary")).alias("id"), F.col("path").alias("file_path"), "title", F.col("format").alias("file_format"), "file_hash", "text")
    chunks = chunk_words(documents.select("id", "text"), sizes).withColumnRenamed("id", "document_id")
    if embed is not None:
        chunks = chunks.withColumn("embedding", embed(F.col("content")))
    state = read.join(new.select("path", F.lit(True).alias("ingested")), "path", "left").select("path", F.when(F.col("status") != "ok", F.col("status")).when(F.col("ingested"), "ingested").otherwise("skipped").alias("status"))
    return documents.drop("text"), chunks, state


def _counts() -> list:
    of = lambda hit: F.count(F.when(hit, 1))
    status = F.col("status")
    return [of(status == "ingested").alias("ingested"), of(status == "skipped").alias("skipped"), of(~status.isin("ingested", "skipped")).alias("errors")]


def counters(state: DataFrame) -> DataFrame:
    """ingested, skipped and errors (what can't be read) of an ingest's status."""
    return state.agg(*_counts())


def counted(state: DataFrame) -> tuple[DataFrame, Callable[[], dict]]:
    """An ingest's status, and a function that gives its counters once that status has been written or collected: they
    are counted in the same pass, and the files aren't read again."""
    seen = Observation()
    return state.observe(seen, *_counts()), lambda: dict(seen.get)


def sync_counted(before: DataFrame, after: DataFrame, key: str, version: str) -> tuple[DataFrame, Callable[[], dict]]:
    """key and status (added, changed, removed, same) of a source's rows against those that were read before, and a
    function that gives the number of each, counted while the status is written."""
    a, b = before.select(F.col(key), F.col(version).alias("_a"), F.lit(True).alias("_in_a")), after.select(F.col(key), F.col(version).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    seen = Observation()
    found = a.join(b, key, "full_outer").select(key, status.alias("status"))
    return found.observe(seen, *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("added", "changed", "removed", "same")]), lambda: dict(seen.get)


def search_notes(parsed: DataFrame, text: str | None = None, tags: list[str] | None = None, link: str | None = None, front: tuple[str, str | None] | None = None, limit: int = 20) -> DataFrame:
    """Parsed notes by text in title or body, tags, link target and front matter."""
    hit = F.lit(True)
    if tags:
        hit = hit & filters.tagged(F.col("tags"), tags)
    if link:
        hit = hit & filters.links_to(F.transform("wikilinks", lambda l: l["target"]), link)
    if front:
        hit = hit & filters.front_matter_has(F.col("frontmatter"), *front)
    if text:
        hit = hit & (filters.has(F.col("title"), text) | filters.has(F.col("text"), text))
    return parsed.where(hit).select("id", "relative_path", "title", "tags", F.slice(F.transform("wikilinks", lambda l: l["target"]), 1, 10).alias("links")).orderBy("relative_path").limit(limit)


def search_items(items: DataFrame, query: str | None = None, author: str | None = None, year: str | None = None, tags: list[str] | None = None, limit: int = 20, collection: str | None = None, library: str | None = None) -> DataFrame:
    """Bibliography items by free text, author, year, tags, a collection's name and a library's."""
    hit = F.lit(True)
    if author:
        hit = hit & filters.author_is(F.lit(None).cast("string"), F.col("creators"), author)
    if year:
        hit = hit & filters.year_is(F.col("date"), year)
    if tags:
        hit = hit & filters.tagged(F.col("tags"), tags)
    if collection:
        hit = hit & filters.any_has(F.col("collections"), collection)
    if library:
        hit = hit & filters.has(F.col("library"), library)
    if query:
        hit = hit & filters.text_has([F.col("title"), F.col("abstract"), F.array_join("tags", " "), F.array_join(F.map_values("fields"), " ")], query)
    return items.where(hit).limit(limit)


def search_indexed_items(documents: DataFrame, chunks: DataFrame, query: str | None = None, hits: DataFrame | None = None, author: str | None = None, year: str | None = None, tags: list[str] | None = None, limit: int = 20, collection: str | None = None, library: str | None = None) -> DataFrame:
    """The same over indexed items, with an excerpt of their first chunk.

    documents (doc_id, title, author, creators, year, abstract, tags, collections, library), chunks (doc_id,
    chunk_index, content). query is looked for in titles and abstracts; hits (doc_id) are those of a search in contents.
    """
    hit = F.lit(True)
    if author:
        hit = hit & filters.author_is(F.col("author"), F.col("creators"), author)
    if year:
        hit = hit & filters.year_is(F.col("year"), year)
    if tags:
        hit = hit & filters.tagged(F.col("tags"), tags)
    if collection:
        hit = hit & filters.any_has(F.col("collections"), collection)
    if library:
        hit = hit & filters.has(F.col("library"), library)
    some = documents.where(hit)
    if query:
        named = filters.has(F.col("title"), query) | filters.has(F.col("abstract"), query)
        if hits is not None:
            some = some.join(hits.select("doc_id", F.lit(True).alias("_hit")).distinct(), "doc_id", "left").where(named | F.col("_hit")).drop("_hit")
        else:
            some = some.where(named)
    some = some.orderBy("doc_id").limit(limit)
    first = chunks.join(some.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.substring("content", 1, 300), "chunk_index").alias("excerpt"))
    return some.withColumn("abstract", F.substring("abstract", 1, 500)).join(first, "doc_id", "left")


def explore(nodes: DataFrame, edges: DataFrame, text: str, depth: int = 2, most: int = 100) -> dict:
    """The neighbourhood of the node that text names, or suggestions."""
    start = graph.find_node(nodes, text).first()
    if start is None:
        return {"found": False, "suggestions": [r["label"] for r in graph.suggestions(nodes, text).collect()]}
    near, links = graph.neighbourhood(edges, start["id"], depth, most)
    return {"found": True, "start": start["id"], "nodes": near, "edges": links}


@dataclass
class Agent:
    """Asks a model for a thought and an action or an answer, runs the action, and shows it what came."""

    model: Callable[[str], str]
    tools: dict[str, Callable[[str], tuple[str, list[dict]]]] = field(default_factory=dict)
    most: int = 5
    sources: dict[str, dict] = field(default_factory=dict)

    def run(self, question: str) -> dict:
        history, calls = [f"Question: {question}"], []
        for _ in range(self.most):
            step = read_step(self.model("\n".join(history)))
            if step.get("answer") or step.get("action") not in self.tools:
                return {"answer": step.get("answer") or step.get("thought") or "", "calls": calls, "sources": list(self.sources.values())}
            seen, found = self.tools[step["action"]](step.get("action_input") or "")
            for source in found:  # the first of a chunk's hits stays
                self.sources.setdefault(source["chunk_id"], source)
            calls.append((step["action"], step.get("action_input")))
            history += [f"Thought: {step.get('thought', '')}", f"Observation: {seen}"]
        return {"answer": self.model("\n".join([*history, "Answer now."])), "calls": calls, "sources": list(self.sources.values())}


def read_step(text: str) -> dict:
    """The JSON object of a model's answer; without one the text is the answer."""
    start, end = text.find("{"), text.rfind("}")
    if 0 <= start < end:
        try:
            found = json.loads(text[start : end + 1])
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
    return {"answer": text}


def hash_embedding(text, width: int = 64):
    """A column of vectors made from hashes of a text's terms: a stand-in for a model, the same on every run."""
    from ..functions.text import terms

    parts = F.transform(terms(text), lambda t: F.xxhash64(t))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(parts, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(width)) == i, F.signum(F.shiftright(h, 7).cast("double"))).otherwise(0.0)).cast("float"))


def find(index: LexicalIndex, vectors: DataFrame, questions: DataFrame, k: int = 10, lexical: bool = True) -> DataFrame:
    """The best k chunks of index for each of questions (query_id, text, query): hybrid, or by vectors alone.

    vectors (the index's keys, embedding) holds those of chunks. Both sides fetch max(5 k, 50) candidates.
    """
    keys, wide = index.keys, max(5 * k, 50)
    dense = search.exact_nearest(vectors.withColumn("vec_id", F.struct(*keys)), questions.where("query is not null").select("query_id", "query"), wide if lexical else k)
    dense = dense.select("query_id", "vec_id.*", "score", "rank")
    if not lexical:
        return dense
    sparse = index.search(questions.select("query_id", "text"), wide)
    return search.hybrid(dense.select("query_id", *keys, "rank"), sparse.select("query_id", *keys, "rank"), index.texts.select(*keys, "content"), questions.select("query_id", "text"), keys, k)


def search_documents(index: LexicalIndex, vectors: DataFrame, documents: DataFrame, questions: DataFrame, k: int = 10, source_types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """query_id, rank, keys, score, content, level, and the columns of documents (doc_id, source_type, ...): twice k
    hybrid hits, those of documents that are there, of some types and of at least some score, compressed, and k of them."""
    hits = find(index, vectors, questions, 2 * k).join(documents, "doc_id")
    if source_types:
        hits = hits.where(F.col("source_type").isin(source_types))
    full = hits.where(F.col("score") >= least).join(index.texts.select(*index.keys, "content"), index.keys)
    kept = compress.compress(full.withColumnRenamed("rank", "place"), ["query_id"], "place")
    return search.top(kept, k, ["query_id"], [F.col("place")]).drop("place")


def _evidence(found: DataFrame, described: Column, none: str, questions: DataFrame) -> DataFrame:
    """query_id, text, elements: the numbered contents of found (query_id, rank, content) under a line that describes each."""
    block = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), described, F.lit("\n"), F.col("content"))
    listed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("s"))
    listed = listed.select("query_id", F.array_join(F.transform("s", lambda x: x["block"]), "\n\n---\n\n").alias("elements"))
    return questions.join(listed, "query_id", "left").withColumn("elements", F.coalesce("elements", F.lit(none)))


def _holding(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """nodes beside each of questions (query_id, text) that their label holds, whatever the case. They meet by the first
    three characters of the text, or all of a shorter one, which a label that holds it has somewhere."""
    parts = F.transform(F.sequence(F.lit(1), F.length("_low")), lambda i: F.array(*[F.col("_low").substr(i, F.lit(n)) for n in (1, 2, 3)]))
    # An empty text is in every label.
    starts = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(parts)))
    held = nodes.withColumn("_low", F.lower("label")).withColumn("_start", F.explode(starts))
    asked = questions.select("query_id", F.lower("text").alias("_theme")).withColumn("_start", F.substring("_theme", 1, 3))
    return held.join(asked, "_start").where(F.contains("_low", "_theme")).drop("_low", "_start", "_theme")


def connections_prompt(found: DataFrame, questions: DataFrame, nodes: DataFrame, edges: DataFrame, beyond: bool = True) -> DataFrame:
    """query_id, prompt: asks for unexpected connections around each of questions (query_id, text).

    found (query_id, rank, source_type, title, content) are a theme's compressed hits. The map lists up to five nodes
    (id, label, kind, ord) whose label holds the theme, then up to fifteen of their neighbours.
    """
    named = _holding(nodes, questions).select("query_id", "id", "label", "kind", "ord")
    named = search.top(named, 5, ["query_id"], [F.col("ord")])
    around = graph.arcs(edges).join(named.select("query_id", F.col("id").alias("from")), "from").select("query_id", F.col("to").alias("id")).distinct()
    around = search.top(around.join(nodes, "id").select("query_id", "id", "label", "kind", "ord"), 15, ["query_id"], [F.col("ord")])
    line = F.concat(F.lit("- "), F.col("label"), F.lit(" ("), F.col("kind"), F.lit(")"))
    listed = named.withColumn("part", F.lit(0)).union(around.withColumn("part", F.lit(1))).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("part", "rank", line.alias("line")))).alias("m"))
    listed = listed.select("query_id", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("map"))
    both = _evidence(found, F.concat(F.lit("("), F.col("source_type"), F.lit(") "), F.col("title")), "The corpus holds nothing on this theme.", questions).join(listed, "query_id", "left")
    reach = "General knowledge may be drawn on beside the corpus." if beyond else "Only what stands in the corpus may be used."
    return both.select("query_id", F.concat(
        F.lit("Help a historian to find connections that surprise; do not sum up.\n\n"), F.lit(reach), F.lit("\n\nTheme: "), F.col("text"),
        F.lit("\n\n## From the corpus\n\n"), F.col("elements"), F.lit("\n\n## Map of the theme\n\n"), F.coalesce("map", F.lit("The graph has no entry for it.")),
        F.lit("\n\n## Task\n\nName links between these elements that aren't plain, at least one that leads out of the corpus, and questions not asked yet. Argue each. Answer in the theme's language."),
    ).alias("prompt"))


def check_prompt(found: DataFrame, questions: DataFrame, strict: bool = False) -> DataFrame:
    """query_id, prompt: confronts each hypothesis of questions (query_id, text) with found (query_id, rank, source_type,
    title, author, year, content), its compressed hits: ten at most where strict, else twenty."""
    some = found.where(F.col("rank") < (10 if strict else 20))
    described = F.concat(F.lit("("), F.col("source_type"), F.lit(") "), F.col("title"), F.coalesce(F.concat(F.lit(", "), F.nullif("author", F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.nullif("year", F.lit("")), F.lit(")")), F.lit("")))
    how = "Look above all for what contradicts or weakens it." if strict else "Look for support, contradiction and nuance alike."
    return _evidence(some, described, "The corpus holds no evidence on it.", questions).select("query_id", F.concat(
        F.lit("Hypothesis: "), F.col("text"), F.lit(f"\n\n{how}\n\n## From the corpus\n\n"), F.col("elements"),
        F.lit("\n\n## Task\n\nSort the elements into supporting, contradicting and nuancing ones and say how strong each is. Name sources that are missing. Suggest a better wording where they call for one. Answer in the hypothesis' language."),
    ).alias("prompt"))


def entity_context(mentions: DataFrame, documents: DataFrame, text: str, related: int = 15, notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Of entities whose name contains text: themselves, their documents with a first excerpt, related entities, and tags.

    mentions (doc_id, chunk_index, name, excerpt), documents (doc_id, title, tags; file_path where there are notes).
    Tags are those of the documents, and of notes (relative_path, tags) that are files of documents of their titles.
    """
    named = mentions.where(filters.has(F.col("name"), text))
    entities = named.groupBy("name").agg(F.count("*").alias("occurrences"))
    first = named.groupBy("doc_id").agg(F.min(F.struct("chunk_index", "excerpt")).alias("x"))
    found = first.join(documents, "doc_id").select("doc_id", "title", F.col("x.excerpt").alias("excerpt"), "tags")
    near = graph.cooccurrence(mentions.join(named.select("doc_id", "chunk_index").distinct(), ["doc_id", "chunk_index"], "left_semi"), ["doc_id", "chunk_index"], "name")
    one, other = filters.has(F.col("e1"), text), filters.has(F.col("e2"), text)
    pairs = near.where(one & ~other).select(F.col("e2").alias("name"), "weight").union(near.where(other & ~one).select("e1", "weight"))
    ranked = pairs.groupBy("name").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "name").limit(related)
    tags = found.select(F.explode("tags").alias("tag"))
    if notes is not None:
        paths = documents.join(found.select("title"), "title", "left_semi").select(F.col("file_path").alias("relative_path"))
        tags = tags.union(notes.join(paths, "relative_path", "left_semi").select(F.explode("tags")))
    tags = tags.distinct().orderBy("tag")
    return {"entities": entities, "documents": found, "related": ranked, "tags": tags}
