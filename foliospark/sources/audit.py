"""The audit log: one JSON object a line, appended to and read from the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, type string, name string, input string, outputSummary struct<itemCount:long,totalChars:long,truncated:boolean>, clientInfo struct<name:string,version:string>"


def append(entries: DataFrame, folder: str) -> None:
    """entries with a timestamp, where they have none, as lines in new files of folder."""
    stamped = entries if "timestamp" in entries.columns else entries.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    stamped.write.mode("append").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Entries; lines that are not JSON objects are dropped."""
    lines = spark.read.text(folder)
    parsed = lines.select(F.from_json("value", SCHEMA).alias("e")).where("e is not null and e.type is not null")
    return parsed.select("e.*")


def status(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))


def tail(entries: DataFrame, n: int = 50) -> DataFrame:
    return entries.orderBy(F.desc("timestamp")).limit(n)
