"""Change events: debounce, snapshot differences, folder watching and ingest loops as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import readable


def debounce(events: DataFrame, ts: str, key: str, gap: str, order: str) -> DataFrame:
    """key, fires_at, last_event, n: one firing, gap after the last event, for each burst of a key's events
    that follow each other within gap. Works on batches and, with a watermark, on streams."""
    sessions = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max(F.struct(ts, order)).alias("last"), F.count("*").alias("n"))
    return sessions.select(key, F.col("w.end").alias("fires_at"), F.col(f"last.{order}").alias("last_event"), "n")


def debounce_stream(events: DataFrame, ts: str, key: str, gap: str, order: str, late: str) -> DataFrame:
    """The same for a stream whose events come up to late after their time."""
    return debounce(events.withWatermark(ts, late), ts, key, gap, order)


def snapshot(spark: SparkSession, folder: str, extensions: tuple[str, ...], depth: int | None = None) -> DataFrame:
    """path, modified, size of the readable files below folder, at most depth folders down."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    relative = F.regexp_replace("path", rf"\A.*?\Q{folder.rstrip('/').removeprefix('file://')}\E/?", "")
    files = files.where(readable(relative, extensions))
    return files.where(F.size(F.split(relative, "/")) - 1 <= depth) if depth is not None else files


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and event (add, change, unlink) between two snapshots; the file source itself sees no deletes."""
    a, b = before.select("path", F.struct("modified", "size").alias("x")), after.select("path", F.struct("modified", "size").alias("y"))
    event = F.when(F.col("x").isNull(), "add").when(F.col("y").isNull(), "unlink").when(F.col("x") != F.col("y"), "change")
    return a.join(b, "path", "full_outer").select("path", event.alias("event")).where("event is not null")


def watch(spark: SparkSession, folder: str, extensions: tuple[str, ...], most_files: int = 200) -> DataFrame:
    """A stream of path, modified, content of new files below folder. Files beyond most_files wait for the next batch."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return stream.where(readable(F.regexp_extract("path", r"([^/]+)$", 1), extensions)).select("path", F.col("modificationTime").alias("modified"), "content")


def ingest_stream(stream: DataFrame, ingest, checkpoint: str, every: str = "2 seconds"):
    """Runs ingest(batch, batch_id) on what has come since the last trigger; a batch that fails is run again."""
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def counts_by_type(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Progress of a stream of events (ts, event_type): numbers in each window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def latest(spark: SparkSession, store, names: list[str]) -> dict[str, DataFrame]:
    """A store's tables, all as its newest commit has them, for a batch that starts now."""
    tables = store.read_all()
    return {n: tables[n] for n in names}


def progress(query) -> DataFrame:
    """batch, rows, and seconds of what a streaming query has done lately."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()
    rows = [(int(p["batchId"]), int(p["numInputRows"]), float(p["durationMs"].get("triggerExecution", 0)) / 1000) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, rows long, seconds double")
