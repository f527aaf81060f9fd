"""Workspaces: a folder with a configuration file, read and written as JSON through Spark's file systems."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a workspace's configuration lies, newest layout first.
PLACES = ("workspace.json", ".workspace/config.json")


@dataclass
class Workspace:
    name: str
    createdAt: str = ""
    language: str = "en"
    watchedFolders: list[str] = field(default_factory=list)
    lastOpenedAt: str | None = None


def create(spark: SparkSession, folder: str, workspace: Workspace) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{PLACES[0]}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(asdict(workspace)).encode()))
    out.close()


def load(spark: SparkSession, folder: str) -> Workspace:
    jvm = spark.sparkContext._jvm
    for place in PLACES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{place}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found = json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])
            return Workspace(**{k: v for k, v in found.items() if k in Workspace.__dataclass_fields__})
    raise FileNotFoundError(f"No workspace found in {folder}")


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """name, lastOpenedAt of the configurations that pattern matches, last opened first; unreadable ones are skipped."""
    files = spark.read.text(pattern, wholetext=True).select(F.from_json("value", "name string, lastOpenedAt string").alias("w"))
    return files.where("w.name is not null").select("w.*").orderBy(F.desc_nulls_last("lastOpenedAt"), "name")


def update(spark: SparkSession, folder: str, **changes) -> Workspace:
    """The workspace with some of its settings replaced, written in the newest layout."""
    found = load(spark, folder)
    for key, value in changes.items():
        if key not in Workspace.__dataclass_fields__:
            raise ValueError(f"{key} is no setting of a workspace")
        setattr(found, key, value)
    create(spark, folder, found)
    return found


def delete(spark: SparkSession, folder: str) -> bool:
    """Removes the configurations of a folder, and nothing else in it."""
    jvm, gone = spark.sparkContext._jvm, False
    for place in PLACES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{place}")
        gone = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False) or gone
    return gone
