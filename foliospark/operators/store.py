"""Tables with the store's semantics: upserts that cascade, inserts that keep the first, deletes, purges.

A store is a folder of Parquet tables and commits (commits.py) that name the folders of each table's rows. Every
change, however many tables it touches, is one commit: readers see all of it or nothing, also where a writer fails
half-way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Changed, Commits  # noqa: F401  Changed is what writers meet

#: Tables, their columns, and what hangs on what.
SCHEMAS = {
    "documents": "id string, file_path string, title string, author string, year string, source_type string, source_ref string, file_format string, page_count int, language string, summary string, summary_embedding array<float>, metadata map<string,string>, created_at string, indexed_at string, file_hash string, file_modified_at string",
    "chunks": "id string, document_id string, content string, page_number int, chunk_index int, start_position int, end_position int, section_title string, section_type string, embedding array<float>, content_hash string, source_type string",
    "vault_notes": "id string, relative_path string, title string, frontmatter map<string,string>, tags array<string>, wikilinks array<struct<target:string,display:string>>, file_hash string, file_mtime long, indexed_at string, created_at string",
    "vault_links": "source_note_id string, target_relative_path string, target_note_id string, display_text string",
    "entities": "id string, name string, type string, normalized_name string, aliases array<string>, created_at string",
    "entity_mentions": "id string, entity_id string, chunk_id string, document_id string, context string",
    "conversation_sessions": "id string, title string, created_at string, updated_at string, metadata string",
    "conversation_messages": "id string, session_id string, role string, content string, sources string, tool_calls string, rag_explanation string, created_at string",
}
CASCADES = {
    "documents": [("chunks", "document_id")],
    "chunks": [("entity_mentions", "chunk_id")],
    "entities": [("entity_mentions", "entity_id")],
    "vault_notes": [("vault_links", "source_note_id")],
    "conversation_sessions": [("conversation_messages", "session_id")],
}


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty texts and page 0 are as good as missing."""
    kinds = dict(df.dtypes)
    out = {c: F.nullif(F.col(c), F.lit("")) for c, t in kinds.items() if t == "string"}
    if "page_number" in kinds:
        out["page_number"] = F.nullif(F.col("page_number"), F.lit(0))
    return df.withColumns(out)


def numbered(new: DataFrame, column: str = "_order") -> DataFrame:
    """new with the order of its rows, for those who don't give one: as they stand in its partitions."""
    return new.withColumn(column, F.monotonically_increasing_id())


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with their keys; of new rows with one key the last in order stays."""
    ranked = new.withColumn("_order", F.col(order)) if order else numbered(new)
    last = ranked.groupBy(key).agg(F.max_by(F.struct(*new.columns), "_order").alias("_last")).select("_last.*")
    return old.join(new.select(key), key, "left_anti").unionByName(last)


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """old with those rows of new whose keys it lacks; the first in order of several."""
    ranked = new.withColumn("_order", F.col(order)) if order else numbered(new)
    first = ranked.groupBy(key).agg(F.min_by(F.struct(*new.columns), "_order").alias("_first")).select("_first.*")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def cascade(tables: dict[str, DataFrame], table: str, ids: DataFrame, look: bool = False) -> dict[str, DataFrame]:
    """tables without the rows of table whose id is in ids (id), and without all that hangs on them. These are plans,
    and none is computed here. With look it is looked up, table by table, whether anything goes, and tables that nothing
    is taken from stay the same objects: for tables that are stored, as a derived one is derived anew each time."""
    out = dict(tables)
    todo = [(table, ids.select("id"))]
    while todo:
        name, gone = todo.pop()
        for child, column in CASCADES.get(name, []):
            hit = out[child].join(gone.select(F.col("id").alias(column)), column, "left_semi")
            if look and hit.isEmpty():
                continue
            if child in CASCADES:
                todo.append((child, hit.select("id")))
            out[child] = out[child].join(gone.select(F.col("id").alias(column)), column, "left_anti")
        if name == table:
            out[name] = out[name].join(gone, "id", "left_anti")
    return out


class Store:
    #: Commits whose rows are kept for readers that began before the newest.
    KEEP = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, path)

    def _now(self) -> tuple[int, dict]:
        number, state = self.commits.newest()
        return number, (state or {"tables": {}})["tables"]

    def _read(self, name: str, tables: dict) -> DataFrame:
        paths = [f"{self.path}/{d}" for d in tables.get(name, [])]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        return self._read(name, self._now()[1])

    def read_all(self) -> dict[str, DataFrame]:
        """All tables, as one commit has them."""
        tables = self._now()[1]
        return {n: self._read(n, tables) for n in SCHEMAS}

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in self.spark.createDataFrame([], SCHEMAS[name]).dtypes])

    def _commit(self, number: int, tables: dict, written: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> None:
        """One commit after number: written take the place of tables, added go to what they have. Raises Changed where
        somebody else has committed since number was read."""
        tables = dict(tables)
        for name, df, new in [*((n, d, True) for n, d in written.items()), *((n, d, False) for n, d in (added or {}).items())]:
            folder = f"{name}/{uuid.uuid4().hex}"
            self._typed(name, df).write.parquet(f"{self.path}/{folder}")
            tables[name] = [folder] if new else [*tables.get(name, []), folder]
        self.commits.put(number + 1, {"tables": tables})
        self._clean()

    def _clean(self) -> None:
        """Removes the rows that only commits before the newest KEEP name."""
        numbers = self.commits.numbers()
        folders = lambda some: {d for n in some for t in self.commits.get(n)["tables"].values() for d in t}
        for d in folders(numbers[: -self.KEEP]) - folders(numbers[-self.KEEP :]):
            self.commits.delete(d)
        self.commits.forget(self.KEEP)

    def write(self, name: str, df: DataFrame) -> None:
        """df in place of a table."""
        self._commit(*self._now(), {name: df})

    def delete(self, name: str, ids: DataFrame) -> None:
        """Rows by id, and all that hangs on them."""
        number, tables = self._now()
        before = {n: self._read(n, tables) for n in SCHEMAS}
        after = cascade(before, name, ids, look=True)
        self._commit(number, tables, {n: d for n, d in after.items() if d is not before[n]})

    def _put(self, name: str, rows: DataFrame) -> None:
        """Rows in place of those with their ids, and without what hung on these. Where no id is known, files are added
        and nothing else is written."""
        number, tables = self._now()
        rows = empty_to_null(rows)
        before = {n: self._read(n, tables) for n in SCHEMAS}
        if before[name].join(rows.select("id"), "id", "left_semi").isEmpty():
            return self._commit(number, tables, {}, {name: upsert(self._read(name, {}), rows)})
        after = cascade(before, name, rows.select("id"), look=True)
        after[name] = upsert(after[name], rows)
        self._commit(number, tables, {n: d for n, d in after.items() if d is not before[n]})

    def add_documents(self, docs: DataFrame) -> None:
        """Replacing a document deletes it first: its chunks and their mentions go."""
        self._put("documents", docs)

    def add_chunks(self, chunks: DataFrame) -> None:
        self._put("chunks", chunks)

    def add_notes(self, notes: DataFrame) -> None:
        self._put("vault_notes", notes)

    def replace_links(self, links: DataFrame, notes: DataFrame | None = None) -> None:
        """All outgoing links of notes (id) give way to links. Without notes, those that links come from are meant: a
        note whose links are all gone must be named."""
        number, tables = self._now()
        of = links.select("source_note_id")
        if notes is not None:
            of = of.union(notes.select(F.col("id").alias("source_note_id")))
        kept = self._read("vault_links", tables).join(of.distinct(), "source_note_id", "left_anti")
        self._commit(number, tables, {"vault_links": kept.unionByName(self._typed("vault_links", links))})

    def add_entities(self, entities: DataFrame, mentions: DataFrame) -> None:
        """Known ids keep their first name. A mention of an unknown chunk or entity is an error."""
        number, tables = self._now()
        all_entities = insert_absent(self._read("entities", tables), entities)
        lost = mentions.join(self._read("chunks", tables).select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").union(mentions.join(all_entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(*mentions.columns))
        if not lost.isEmpty():
            raise ValueError("a mention refers to a chunk or an entity that is not there")
        self._commit(number, tables, {"entities": all_entities, "entity_mentions": insert_absent(self._read("entity_mentions", tables), mentions)})

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds files; what is there isn't written again."""
        self._commit(*self._now(), {}, {name: rows})

    def get(self, name: str, value, column: str = "id") -> DataFrame:
        """The rows whose column has a value: a document or note by id, path or content hash."""
        return self.read(name).where(F.col(column) == F.lit(value))

    def purge(self) -> None:
        number, _ = self._now()
        self._commit(number, {}, {})
