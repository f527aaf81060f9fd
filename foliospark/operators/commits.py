"""Numbered commits in a folder that all machines share: what a reader finds is whole, whatever writers do meanwhile."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Changed(RuntimeError):
    """Somebody else has committed meanwhile: nothing was changed, and the caller may try again."""


class Commits:
    """Small JSON files, one for each state of a folder. Data files are never changed; a commit names those that count.
    The newest commit is the state; older ones serve readers that began before it, until vacuum() removes them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def fs(self):
        return self.at("_commits").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, *parts: str) -> list[str]:
        """What lies in a folder below path."""
        fs, where = self.fs, self.at(*parts)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("_commits") if n.endswith(".json") and n[:-5].isdigit())

    def get(self, number: int) -> dict:
        stream = self.fs.open(self.at("_commits", f"{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        numbers = self.numbers()
        return (numbers[-1], self.get(numbers[-1])) if numbers else (0, None)

    def put(self, number: int, content: dict) -> None:
        """Makes content the state with this number, unless there is one: then Changed is raised. It is written aside
        and renamed, so that nobody reads a part of it."""
        fs, target = self.fs, self.at("_commits", f"{number}.json")
        aside = self.at("_commits", f".{number}-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Changed(f"{self.path} has a commit {number} already")

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def forget(self, keep: int) -> list[dict]:
        """Removes all but the newest keep commits, and returns those."""
        numbers = self.numbers()
        for n in numbers[: -max(1, keep)]:
            self.delete("_commits", f"{n}.json")
        return [self.get(n) for n in numbers[-max(1, keep) :]]
