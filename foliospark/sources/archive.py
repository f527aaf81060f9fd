"""An image archive's database: items with metadata, tags, notes, transcriptions and photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text
from .bibliography import ordered_list, pivot_fields
from .sqlite import read_tables

#: Tables and the columns that are read.
TABLES = {
    "project": "name string",
    "items": "id long",
    "subjects": "id long, template string, type string",
    "trash": "id long",
    "metadata": "id long, property string, value_id long",
    "metadata_values": "value_id long, text string",
    "tags": "tag_id long, name string",
    "taggings": "tag_id long, id long",
    "notes": "note_id long, id long, text string, state string, language string, deleted string",
    "photos": "id long, item_id long, path string, protocol string, mimetype string, filename string, page long, position long",
    "transcriptions": "transcription_id long, id long, text string, status long, deleted string",
}
_DC = ("http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/", "")


def first_of(metadata: Column, name: str) -> Column:
    """The first there is of the vocabularies' properties of a name."""
    return F.coalesce(*[F.nullif(F.try_element_at(metadata, F.lit(p + name)), F.lit("")) for p in _DC])


def item_title(metadata: Column, item_id: Column) -> Column:
    return F.coalesce(first_of(metadata, "title"), F.concat(F.lit("Item "), item_id.cast("string")))


def item_text(metadata: Column, notes: Column, transcriptions: Column) -> Column:
    """Title, description, date, other properties by their short names, notes and transcriptions, with blank lines between."""
    others = F.filter(F.map_entries(metadata), lambda e: ~(e["key"].contains("title") | e["key"].contains("description") | e["key"].contains("date")))
    named = F.transform(others, lambda e: F.concat(F.element_at(F.split(e["key"], "/"), -1), F.lit(": "), e["value"]))
    plain = lambda texts: F.filter(F.transform(texts, lambda t: html_to_text(t, drop_code=False)), lambda t: t.isNotNull() & (t != ""))
    empty = F.array().cast("array<string>")
    return F.concat_ws("\n\n", first_of(metadata, "title"), first_of(metadata, "description"), F.concat(F.lit("Date: "), first_of(metadata, "date")), F.coalesce(named, empty), F.coalesce(plain(notes), empty), F.coalesce(plain(transcriptions), empty))


class Archive:
    def __init__(self, tables: dict[str, DataFrame], base: str = ""):
        self.t, self.base = tables, base.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Archive":
        """path is the database file, or a folder that holds project.tpy."""
        file = path if path.endswith(".tpy") else f"{path.rstrip('/')}/project.tpy"
        return cls(read_tables(spark, file, TABLES), file.rpartition("/")[0])

    def name(self) -> DataFrame:
        return self.t["project"].select("name").limit(1)

    def all_tags(self) -> DataFrame:
        return self.t["tags"].select("name").orderBy("name")

    def items(self) -> DataFrame:
        """Items outside the trash with all that belongs to them."""
        t = self.t
        i = t["items"].join(t["trash"], "id", "left_anti").join(t["subjects"], "id")
        metadata = pivot_fields(t["metadata"].join(t["metadata_values"], "value_id").where("text is not null and text <> ''").select(F.col("id").alias("item"), F.col("property").alias("field"), F.col("text").alias("value"))).select(F.col("item").alias("id"), F.col("fields").alias("metadata"))
        tags = t["taggings"].join(t["tags"], "tag_id").groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("tags"))
        note = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("language", F.lit("en")).alias("language"))
        notes = ordered_list(t["notes"].where("deleted is null"), "id", ["note_id"], note).withColumnRenamed("values", "notes")
        of_photo = t["transcriptions"].where("deleted is null and text is not null").join(t["photos"].select("id", F.col("item_id")), "id")
        transcriptions = ordered_list(of_photo, "item_id", ["transcription_id"], F.col("text")).select(F.col("item_id").alias("id"), F.col("values").alias("transcriptions"))
        where = F.when((F.col("protocol") == "file") & (F.col("path") != "") & ~F.startswith("path", F.lit("/")), F.concat_ws("/", F.lit(self.base), F.col("path"))).otherwise(F.coalesce("path", F.lit("")))
        photo = F.struct(where.alias("path"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("protocol", F.lit("file")).alias("protocol"), F.coalesce("page", F.lit(0)).alias("page"))
        photos = ordered_list(t["photos"], "item_id", ["position", "id"], photo).select(F.col("item_id").alias("id"), F.col("values").alias("photos"))
        out = i
        for more in (metadata, tags, notes, transcriptions, photos):
            out = out.join(more, "id", "left")
        text = item_text(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.transform("notes", lambda n: n["text"]), F.col("transcriptions"))
        return out.withColumn("title", item_title(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.col("id"))).withColumn("content", text)

    def statistics(self) -> DataFrame:
        """items, with_notes, with_photos and the tags of items, in order."""
        i = self.items()
        return i.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), F.count("*").alias("items"), F.count(F.when(F.size("notes") > 0, 1)).alias("with_notes"), F.count(F.when(F.size("photos") > 0, 1)).alias("with_photos"))
