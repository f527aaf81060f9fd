"""Markdown exports of answers and conversations, and how they get into folders."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import short_title
from ..operators.commits import Commits
from ..operators.lineage import cut


def conversation_bodies(messages: DataFrame) -> DataFrame:
    """conv_id, message_count, body of messages (conv_id, turn, role, text): a section for each turn."""
    heading = F.when(F.col("role") == "user", "Question").otherwise("Answer")
    section = F.concat(F.lit("## "), heading, F.lit("\n\n"), F.col("text"))
    listed = F.sort_array(F.collect_list(F.struct("turn", section.alias("section"))))
    m = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), listed.alias("s"))
    return m.select("conv_id", "message_count", F.array_join(F.transform("s", lambda x: x["section"]), "\n\n").alias("body"))


def front_matter(title, day, tags: list[str], extra: dict | None = None):
    """A YAML block with a quoted title."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(short_title(title), '"', '\\\\"'), F.lit('"'))
    lines = [F.concat(F.lit("title: "), quoted), F.concat(F.lit("date: "), day), F.lit("tags: [" + ", ".join(tags) + "]")]
    lines += [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in (extra or {}).items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def exchange(question, answer, references, day):
    """One question with its answer and an array of references, as a note."""
    sources = F.transform(references, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    tail = F.when(F.size(references) > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(sources, "\n"))).otherwise("")
    return F.concat(front_matter(question, day, ["export"]), F.lit("## Question\n\n"), question, F.lit("\n\n## Answer\n\n"), answer, tail, F.lit("\n"))


def places(rows: DataFrame, stem: str, order: list[str], column: str = "place") -> DataFrame:
    """rows with their place (from 0) among those with one stem, in order. Rows are ranged by stem and order, so that a
    stem that very many share is counted in many tasks; only numbers of rows a range are added up."""
    ranged = cut(rows.repartitionByRange(stem, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(stem).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(stem, "_range").agg(F.count("*").alias("n")).select(F.col(stem).alias("_stem"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(stem, "_range").orderBy(*order)) - 1
    joined = ranged.withColumn("_here", here).join(offsets, F.col(stem).eqNullSafe(F.col("_stem")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(column, (F.col("_before") + F.col("_here")).cast("int")).drop("_range", "_r", "_stem", "_before", "_here")


def name_of(stem, number):
    return F.concat(stem, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), F.lit(".md"))


def free_names(notes: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """notes (stem and the columns of order) with file_name: stem.md, or stem-1.md, stem-2.md and so on where taken (file_name) or
    an earlier note has that. Of notes that a number brings to one name the one whose stem it is gets it."""
    todo, done = notes.withColumn("_row", F.monotonically_increasing_id()), None
    todo = cut(todo)
    used = cut(taken.select("file_name").distinct())
    while not todo.isEmpty():
        # A file a-1.md is the first further one of a, and a-1 itself.
        stem = F.regexp_replace("file_name", r"\.md\z", "")
        numbers = used.where(F.col("file_name").endswith(".md")).select(F.explode(F.array(F.struct(stem.alias("stem"), F.lit(0).alias("k")), F.struct(F.regexp_extract(stem, r"\A(.*)-([1-9][0-9]{0,8})\z", 1).alias("stem"), F.regexp_extract(stem, r"\A(.*)-([1-9][0-9]{0,8})\z", 2).try_cast("int").alias("k")))).alias("x"))
        numbers = numbers.select("x.*").where("k is not null").join(todo.select("stem").distinct(), "stem", "left_semi")
        held = numbers.groupBy("stem").agg(F.array_sort(F.collect_set("k")).alias("_held"))
        placed = places(todo, "stem", order).join(held, "stem", "left")
        number = F.aggregate(F.coalesce("_held", F.array().cast("array<int>")), F.col("place"), lambda x, k: x + F.when(k <= x, 1).otherwise(0))
        named = cut(placed.withColumn("_k", number).withColumn("file_name", name_of(F.col("stem"), F.col("_k"))).drop("_held", "place"))
        first = named.groupBy("file_name").agg(F.min(F.struct("_k", "_row")).alias("_first"))
        clash = named.join(first.select(F.col("file_name").alias("_name"), F.col("_first._row").alias("_winner")), F.col("file_name") == F.col("_name"))
        won = cut(clash.where("_row = _winner").drop("_name", "_winner"))
        lost = clash.where("_row <> _winner").select(*todo.columns)
        done = won if done is None else done.unionByName(won)
        used, todo = used.union(won.select("file_name")), cut(lost)
    done = done if done is not None else todo.withColumn("file_name", F.lit("")).withColumn("_k", F.lit(0))
    return done.drop("_row", "_k")


class Written(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class NoteWriter(DataSourceWriter):
    """Each file is written aside and moved to its name. What has the name already is left alone: if it holds the same,
    an earlier attempt of the task has put it there, if not, the task fails."""

    def __init__(self, options):
        self.folder = options["path"].rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        import uuid

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        system.create_dir(top, recursive=True)
        n = 0
        for row in iterator:
            name, body = row["file_name"], (row["body"] or "").encode()
            if "/" in name or name.startswith("."):
                raise ValueError(f"{name} is no name of a note")
            target = f"{top}/{name}"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                with system.open_input_stream(target) as f:
                    if f.read() != body:
                        raise FileExistsError(f"{target} was put there by somebody else meanwhile")
                continue
            aside = f"{top}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as out:
                out.write(body)
            system.move(aside, target)
            n += 1
        return Written(n)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class NoteFiles(DataSource):
    """A sink of notes (file_name, body): a file for each under its own name. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return "file_name string, body string"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        if overwrite:
            raise ValueError("notes are only added")
        return NoteWriter(self.options)


def names_in(spark: SparkSession, folder: str) -> DataFrame:
    """file_name of what lies in a folder, as the driver lists it (Spark's file sources, which list there too, leave empty
    files out); none where the folder isn't there."""
    return spark.createDataFrame([(n,) for n in Commits(spark, folder).names()], "file_name string")


def write_notes(notes: DataFrame, folder: str, order: list[str] | None = None) -> DataFrame:
    """Adds notes (file_name, body) to a folder, a file for each. Where a name is taken, by a file or by an earlier note,
    it gets -1, -2 and so on; nothing that is there is changed. Returns file_name (as written), body and the columns of
    order, by which notes of one name are numbered (default: their bodies)."""
    spark = notes.sparkSession
    order = order or ["body"]
    taken = names_in(spark, folder)
    stems = notes.withColumn("stem", F.regexp_replace("file_name", r"\.md\z", "")).drop("file_name")
    named = cut(free_names(stems, taken, order).drop("stem"))
    spark.dataSource.register(NoteFiles)
    named.select("file_name", "body").write.format("note_files").mode("append").option("path", folder).save()
    return named
