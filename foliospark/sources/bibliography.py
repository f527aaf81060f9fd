"""A bibliography database: libraries, collections, and items with fields, creators, tags and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqlite import read_tables

#: Tables and the columns that are read.
TABLES = {
    "libraries": "libraryID long, type string",
    "groups": "libraryID long, name string",
    "collections": "collectionID long, collectionName string, key string, parentCollectionID long, libraryID long",
    "collectionItems": "collectionID long, itemID long",
    "items": "itemID long, key string, itemTypeID long, libraryID long, dateAdded string, dateModified string",
    "itemTypes": "itemTypeID long, typeName string",
    "deletedItems": "itemID long",
    "itemData": "itemID long, fieldID long, valueID long",
    "fields": "fieldID long, fieldName string",
    "itemDataValues": "valueID long, value string",
    "itemCreators": "itemID long, creatorID long, creatorTypeID long, orderIndex long",
    "creators": "creatorID long, firstName string, lastName string",
    "creatorTypes": "creatorTypeID long, creatorType string",
    "itemTags": "itemID long, tagID long",
    "tags": "tagID long, name string",
    "itemAttachments": "itemID long, parentItemID long, contentType string, path string, linkMode long",
}


def ordered_list(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """key and the array values of its rows' value in order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, value.alias("_v"))))
    return rows.groupBy(key).agg(listed.alias("_s")).select(key, F.transform("_s", lambda x: x["_v"]).alias("values"))


def pivot_fields(rows: DataFrame, key: str = "item", order: str | None = None) -> DataFrame:
    """key and the map fields of rows (key, field, value); of a field that comes twice the last value in order, or the
    last of the rows as they stand."""
    ranked = rows.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id())
    one = ranked.groupBy(key, "field").agg(F.max_by("value", "_order").alias("value"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def for_display(named: DataFrame) -> DataFrame:
    """Libraries or collections (name) as readers see them: in French order, of libraries (type) users' first."""
    french = F.collate(F.col("name"), "fr")
    return named.orderBy(F.col("type") != "user", french) if "type" in named.columns else named.orderBy(french)


class Bibliography:
    def __init__(self, tables: dict[str, DataFrame]):
        self.t = tables

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Bibliography":
        return cls(read_tables(spark, path, TABLES))

    def libraries(self) -> DataFrame:
        """libraryID, type, name: users' and groups' libraries; users' have a common name."""
        named = self.t["libraries"].join(self.t["groups"], "libraryID", "left").where(F.col("type").isin("user", "group"))
        return named.select("libraryID", "type", F.coalesce("name", F.lit("My Library")).alias("name")).orderBy("type", "name")

    def collections(self, library: int | None = None) -> DataFrame:
        c = self.t["collections"]
        parents = c.select(F.col("collectionID").alias("parentCollectionID"), F.col("key").alias("parentKey"))
        c = c.where(F.col("libraryID") == library) if library is not None else c
        return c.join(parents, "parentCollectionID", "left").select("key", F.col("collectionName").alias("name"), "parentKey").orderBy("name")

    def items(self, collection: str | None = None, library: int | None = None) -> DataFrame:
        """Items that are neither attachments, notes nor deleted, newest first, with all that belongs to them."""
        t = self.t
        i = t["items"].join(t["itemTypes"].where(~F.col("typeName").isin("attachment", "note")), "itemTypeID").join(t["deletedItems"], "itemID", "left_anti")
        if collection:
            inside = t["collectionItems"].join(t["collections"].where(F.col("key") == collection).select("collectionID"), "collectionID").select("itemID")
            i = i.join(inside, "itemID", "left_semi")
        elif library is not None:
            i = i.where(F.col("libraryID") == library)
        fields = pivot_fields(t["itemData"].join(t["fields"], "fieldID").join(t["itemDataValues"], "valueID").select(F.col("itemID").alias("item"), F.col("fieldName").alias("field"), "value", "fieldID"), order="fieldID")
        person = F.struct(F.coalesce("firstName", F.lit("")).alias("first"), F.coalesce("lastName", F.lit("")).alias("last"), F.col("creatorType").alias("type"))
        creators = ordered_list(t["itemCreators"].join(t["creators"], "creatorID").join(t["creatorTypes"], "creatorTypeID"), "itemID", ["orderIndex", "creatorID"], person).withColumnRenamed("values", "creators")
        tags = t["itemTags"].join(t["tags"], "tagID").groupBy("itemID").agg(F.sort_array(F.collect_list("name")).alias("tags"))
        collections = t["collectionItems"].join(t["collections"], "collectionID").groupBy("itemID").agg(F.sort_array(F.collect_list("key")).alias("collection_keys"), F.sort_array(F.collect_list("collectionName")).alias("collections"))
        out = i.select("itemID", "key", F.col("typeName").alias("item_type"), "libraryID", "dateAdded").join(fields.withColumnRenamed("item", "itemID"), "itemID", "left")
        for more in (creators, tags, collections, self.attachments()):
            out = out.join(more, "itemID", "left")
        out = out.join(self.libraries().select("libraryID", F.col("name").alias("library")), "libraryID", "left")
        empty = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), dict(out.dtypes)[c])).alias(c)
        value = lambda k: F.try_element_at("fields", F.lit(k))
        return out.select("itemID", "key", "item_type", "libraryID", F.coalesce(F.nullif(value("title"), F.lit("")), F.lit("Untitled")).alias("title"), value("date").alias("date"), value("abstractNote").alias("abstract"), "fields", empty("creators"), empty("tags"), empty("collection_keys"), empty("collections"), "library", empty("attachments"), "dateAdded").orderBy(F.desc("dateAdded"), "itemID")

    def attachments(self) -> DataFrame:
        """itemID of the parent, and its attachments."""
        a = self.t["itemAttachments"].join(self.t["items"].select("itemID", "key"), "itemID").join(self.t["deletedItems"], "itemID", "left_anti")
        return a.where("parentItemID is not null").groupBy(F.col("parentItemID").alias("itemID")).agg(F.sort_array(F.collect_list(F.struct("key", F.col("contentType").alias("content_type"), "path", F.col("linkMode").alias("link_mode")))).alias("attachments"))

    def collection_names(self, keys: list[str]) -> DataFrame:
        return self.t["collections"].where(F.col("key").isin(*keys)).select("key", F.col("collectionName").alias("name"))

    def library_of(self, key: str) -> DataFrame:
        return self.t["items"].where(F.col("key") == key).select("libraryID").join(self.libraries(), "libraryID")


def pdf_path(attachments: Column, folder: str) -> Column:
    """Where an item's first PDF lies: stored ones below folder, linked ones where they say."""
    pdf = F.get(F.filter(attachments, lambda a: (a["content_type"] == "application/pdf") & a["path"].isNotNull() & (a["path"] != "")), 0)
    stored = F.concat_ws("/", F.lit(folder.rstrip("/")), F.lit("storage"), pdf["key"], F.regexp_replace(pdf["path"], "^storage:", ""))
    return F.when(F.startswith(pdf["path"], F.lit("storage:")), stored).otherwise(pdf["path"])
