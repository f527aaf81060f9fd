"""Tables that grow by segments and shrink by tombstones.

Each addition writes one segment: a folder for each of its tables. Each deletion writes the deleted keys alone. Both
end with one commit that names what counts, so that readers see all tables of an addition or none, and a plan made
before a change keeps reading the files that it was made for. Compaction writes one segment of what is left; files
that no kept commit names go with vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .commits import Commits

#: Up to this many deleted keys are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 1 << 18
_PART = [StructField("_seq", LongType()), StructField("_id", StringType())]


class Snapshot:
    """The tables as one commit has them."""

    def __init__(self, spark: SparkSession, path: str, number: int, state: dict):
        self.spark, self.path, self.number, self.state = spark, path, number, state

    @property
    def properties(self) -> dict:
        return self.state["properties"]

    def total(self, what: str) -> float:
        """The sum of a figure over segments, less what tombstones took."""
        return sum(s["figures"].get(what, 0) for s in self.state["segments"]) - sum(t["figures"].get(what, 0) for t in self.state["tombstones"])

    def table(self, name: str, dead: bool = False) -> DataFrame:
        """A table's rows; dead also gives those that tombstones name."""
        schema = StructType.fromJson(json.loads(self.state["schemas"][name]))
        wanted = StructType([*schema.fields, *_PART])
        paths = [f"{self.path}/{name}/_seq={s['seq']}/_id={s['id']}" for s in self.state["segments"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.option("basePath", f"{self.path}/{name}").schema(wanted).parquet(*paths)
        for by in [] if dead else sorted({tuple(t["by"]) for t in self.state["tombstones"]}):
            mine = [t for t in self.state["tombstones"] if tuple(t["by"]) == by]
            kinds = StructType([StructField(f"_{c}", schema[c].dataType) for c in by] + [StructField("_gone", LongType())])
            gone = self.spark.read.schema(kinds).parquet(*[f"{self.path}/_tombstones/{t['id']}" for t in mine])
            gone = gone.groupBy(*[f"_{c}" for c in by]).agg(F.max("_gone").alias("_gone"))
            if sum(t["rows"] for t in mine) <= BROADCAST_ROWS:
                gone = F.broadcast(gone)
            match = F.col("_seq") < F.col("_gone")
            for c in by:
                match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
            df = df.join(gone, match, "left_anti")
        return df.drop("_seq", "_id")


class Segments:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.commits = Commits(spark, self.path)

    def snapshot(self) -> Snapshot:
        number, state = self.commits.newest()
        if state is None:
            raise ValueError(f"no index at {self.path}")
        return Snapshot(self.spark, self.path, number, state)

    def create(self, properties: dict, schemas: dict[str, StructType]) -> Snapshot:
        """An empty state, in a folder that has none."""
        state = {"properties": properties, "schemas": {n: s.json() for n, s in schemas.items()}, "segments": [], "tombstones": []}
        self.commits.put(1, state)
        return Snapshot(self.spark, self.path, 1, state)

    def write(self, now: Snapshot, tables: dict, figures: dict, replaced: DataFrame | None = None, counted: dict | None = None, alone: bool = False) -> Snapshot:
        """Adds a segment. tables: a function for each table that writes it to a path. figures: numbers about the
        segment, or a function that gives them afterwards. Rows of older segments with the keys of replaced go; counted
        are their figures. alone: without any older segment."""
        seq, name = now.number + 1, uuid.uuid4().hex
        for table, put in tables.items():
            put(f"{self.path}/{table}/_seq={seq}/_id={name}")
        state = json.loads(json.dumps(now.state))
        if alone:
            state["segments"], state["tombstones"] = [], []
        state["segments"].append({"seq": seq, "id": name, "figures": figures() if callable(figures) else figures})
        if replaced is not None and counted:
            state["tombstones"].append(self._bury(replaced, self.keys, seq, counted))
        self.commits.put(seq, state)
        return Snapshot(self.spark, self.path, seq, state)

    def _bury(self, gone: DataFrame, by: list[str], seq: int, counted: dict) -> dict:
        name = uuid.uuid4().hex
        path = f"{self.path}/_tombstones/{name}"
        gone.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct().withColumn("_gone", F.lit(seq)).write.parquet(path)
        return {"id": name, "by": by, "rows": self.spark.read.parquet(path).count(), "figures": counted}

    def delete(self, gone: DataFrame, count) -> Snapshot:
        """Writes a tombstone for the rows of gone (some or all of keys): their keys and nothing else. count gives
        the figures of a table of rows; it is asked for those that go."""
        now = self.snapshot()
        by = [k for k in self.keys if k in gone.columns]
        gone = gone.select(*by).distinct()
        seq, state = now.number + 1, json.loads(json.dumps(now.state))
        counted = count(now, gone, by)
        if any(counted.values()):
            state["tombstones"].append(self._bury(gone, by, seq, counted))
            self.commits.put(seq, state)
        return Snapshot(self.spark, self.path, seq, state)

    def vacuum(self, keep: int = 2) -> None:
        """Removes what only commits before the newest keep ones name. Plans made for those can't be run any more."""
        kept = self.commits.forget(keep)
        segments = {s["id"] for state in kept for s in state["segments"]}
        tombstones = {t["id"] for state in kept for t in state["tombstones"]}
        for name in self.commits.names("_tombstones"):
            if name not in tombstones:
                self.commits.delete("_tombstones", name)
        for table in kept[-1]["schemas"]:
            for seq in self.commits.names(table):
                for name in self.commits.names(table, seq):
                    if name.removeprefix("_id=") not in segments:
                        self.commits.delete(table, seq, name)
