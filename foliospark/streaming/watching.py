"""A streaming source of what happens in folders: files added, changed and deleted.

Offsets are numbers of snapshots. A snapshot and the events that lead to it are written to a state folder before its
offset is handed out, so that a batch that is run again, or a query that is started again, reads the same events.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.filters import INGESTED

SCHEMA = "path string, folder string, event string, modified timestamp, size long"


class Events(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class FolderReader(DataSourceStreamReader):
    #: Events of one file of events.
    CHUNK = 1_000

    def __init__(self, options):
        self.folders = [f.rstrip("/") for f in options["path"].split(";") if f]
        self.state = options["state"].rstrip("/")
        self.extensions = tuple(options.get("extensions", ",".join(INGESTED)).lower().split(","))
        self.depth = int(options.get("depth", 3))
        self.stability = float(options.get("stability", 0.5))
        self.initial = options.get("initial", "false").lower() == "true"
        self.most = int(options.get("mostevents", options.get("mostEvents", 200)))
        self.pending: dict[str, tuple] = {}

    def _list(self) -> dict[str, tuple]:
        """path -> (folder, modified, size) of files that count."""
        from pyarrow import fs

        found = {}
        for folder in self.folders:
            system, top = _open(folder)
            for f in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
                parts = f.path[len(top) :].strip("/").split("/")
                if f.type == fs.FileType.File and len(parts) - 1 <= self.depth and not any(p.startswith(".") for p in parts) and parts[-1].rpartition(".")[2].lower() in self.extensions and "." in parts[-1]:
                    found[f.path] = (folder, f.mtime_ns // 1000, f.size)
        return found

    def _names(self, kind: str) -> list[str]:
        from pyarrow import fs

        system, top = _open(f"{self.state}/{kind}")
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if not f.base_name.startswith("."))

    def _put(self, name: str, rows: list) -> None:
        """Written aside and moved, so that a file is there whole or not at all."""
        system, at = _open(f"{self.state}/{name}")
        folder, _, base = at.rpartition("/")
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/.{base}") as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        system.move(f"{folder}/.{base}", at)

    def _get(self, name: str) -> list:
        system, at = _open(f"{self.state}/{name}")
        with system.open_input_stream(at) as f:
            return [json.loads(x) for x in f.read().decode().splitlines()]

    def _snapshots(self) -> list[int]:
        """Their numbers. The first has the files that are there at first, which are no events unless asked for."""
        if not (found := self._names("seen")):
            self._put("seen/0", [] if self.initial else [[p, *x] for p, x in self._list().items()])
        return sorted(map(int, found or ["0"]))

    def initialOffset(self) -> dict:
        return {"n": self._snapshots()[0]}

    def latestOffset(self) -> dict:
        n = self._snapshots()[-1]
        seen = {p: tuple(x) for p, *x in self._get(f"seen/{n}")}
        now, clock, events = self._list(), time.monotonic(), []
        for path, (folder, modified, size) in seen.items():
            if path not in now and folder in self.folders:
                events.append([path, folder, "deleted", modified, size])
        for path, x in now.items():
            if seen.get(path) == x:
                self.pending.pop(path, None)
                continue
            held = self.pending.get(path)
            if held is None or held[0] != x:
                held = self.pending[path] = (x, clock)
            # A file counts once it has kept its time and size for a while.
            if clock - held[1] >= self.stability:
                events.append([path, x[0], "changed" if path in seen else "added", *x[1:]])
        # By time of change; what goes beyond a batch waits for the next.
        events = sorted(events, key=lambda e: (e[3], e[0]))[: self.most]
        if not events:
            return {"n": n}
        for path, folder, event, modified, size in events:
            self.pending.pop(path, None)
            if event == "deleted":
                del seen[path]
            else:
                seen[path] = (folder, modified, size)
        for k in range(0, len(events), self.CHUNK):
            self._put(f"events/{n + 1:012d}-{k // self.CHUNK:06d}", events[k : k + self.CHUNK])
        self._put(f"seen/{n + 1}", [[p, *x] for p, x in seen.items()])
        return {"n": n + 1}

    def partitions(self, start: dict, end: dict) -> list[Events]:
        return [Events(f"events/{name}") for name in self._names("events") if start["n"] < int(name.partition("-")[0]) <= end["n"]]

    def read(self, partition: Events) -> Iterator[tuple]:
        for path, folder, event, modified, size in self._get(partition.path):
            yield path, folder, event, datetime.fromtimestamp(modified / 1e6, UTC), size

    def commit(self, end: dict) -> None:
        """Events before the last batch are done with."""
        for kind, names in (("events", self._names("events")), ("seen", self._names("seen"))):
            for name in names:
                if int(name.partition("-")[0]) < end["n"] - (kind == "events"):
                    system, at = _open(f"{self.state}/{kind}/{name}")
                    system.delete_file(at)


class FolderEvents(DataSource):
    """Options: path (folders, divided by semicolons), state (a folder that driver and executors share, one for each
    query), extensions, depth (3), stability (seconds that a file must rest, 0.5), initial (false: files that are there
    at first are no events), mostEvents in a batch (200; further ones wait)."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def folder_events(spark: SparkSession, folders: list[str], state: str, **options) -> DataFrame:
    """A stream of path, folder, event (added, changed, deleted), modified, size of files below folders, whose names
    and folders don't begin with a dot."""
    spark.dataSource.register(FolderEvents)
    reader = spark.readStream.format("folder_events").option("path", ";".join(folders)).option("state", state)
    for name, value in options.items():
        reader = reader.option(name, ",".join(value) if isinstance(value, (list, tuple)) else str(value))
    return reader.load()


def vault_events(spark: SparkSession, folder: str, state: str, **options) -> DataFrame:
    """The same for a vault's notes, at any depth."""
    return folder_events(spark, [folder], state, **{"extensions": ["md"], "depth": 1_000, **options})
