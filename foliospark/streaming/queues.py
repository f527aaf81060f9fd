"""Keyed state over streams: trailing debounce, serial queues, reloads that run one at a time, and progress."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.commits import Commits


def trailing(events: DataFrame, key: str, order: str, value: str, gap_ms: int) -> DataFrame:
    """key, value, n: a firing for each key that has been quiet for gap_ms of processing time, with the value of its
    last event by order and how many there were. No later event is needed: Spark runs batches for timeouts alone."""
    kind = {c: t for c, t in events.dtypes}

    def step(k, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            _, last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], value: [last], "n": [n]})
            return
        best = state.get if state.exists else None
        for batch in batches:
            ranked = batch.sort_values(order, kind="stable")
            first, last = ranked[order].iloc[-1], ranked[value].iloc[-1]
            n = len(ranked) + (best[2] if best else 0)
            best = (first, last, n) if best is None or not first < best[0] else (*best[:2], n)
        state.update(tuple(x.item() if hasattr(x, "item") else x for x in best))
        state.setTimeoutDuration(gap_ms)

    wanted = events.select(key, order, value)
    return wanted.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {value} {kind[value]}, n long", f"o {kind[order]}, v {kind[value]}, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def queue(events: DataFrame, lane: str, order: str, value: str, size: int = 10, idle_ms: int = 2_000) -> DataFrame:
    """lane, flush, pos, value: each lane's events first in, first out, numbered through (pos) and gathered to flushes
    of size. What doesn't fill one is flushed when the lane has been idle for idle_ms. What state holds is less than a
    flush a lane; nothing is dropped, since the source holds back what goes beyond a batch."""
    kind = {c: t for c, t in events.dtypes}

    def step(k, batches, state):
        import pandas as pd

        flush, pos, waiting = state.get if state.exists else (0, 0, [])
        waiting = list(waiting)
        if not state.hasTimedOut:
            arrived = pd.concat(list(batches))
            waiting += arrived.sort_values([order, value], kind="stable")[value].tolist()
        whole = len(waiting) if state.hasTimedOut else len(waiting) // size * size
        out, waiting = waiting[:whole], waiting[whole:]
        if out:
            yield pd.DataFrame({lane: [k[0]] * len(out), "flush": [flush + i // size for i in range(len(out))], "pos": range(pos, pos + len(out)), value: out})
        state.update((flush + -(-len(out) // size), pos + len(out), waiting))
        if waiting:
            state.setTimeoutDuration(idle_ms)

    wanted = events.select(lane, order, value)
    return wanted.groupBy(lane).applyInPandasWithState(step, f"{lane} {kind[lane]}, flush long, pos long, {value} {kind[value]}", f"flush long, pos long, waiting array<{kind[value]}>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(lane: str, ingest: Callable[[DataFrame], None], flush: Callable[[], None]) -> Callable:
    """For foreachBatch on queue(): flushes one after the other in each lane's order, ingest(rows) and then flush().
    A flush that fails is left out, as a file that can't be read is; the next one goes on."""

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            # As many flushes as the source lets into a batch.
            for r in batch.groupBy(lane, "flush").agg(F.min("pos").alias("pos")).orderBy("pos", lane).collect():
                try:
                    ingest(batch.where(F.col(lane).eqNullSafe(F.lit(r[lane])) & (F.col("flush") == r["flush"])).orderBy("pos"))
                except Exception as e:
                    print(f"flush {r['flush']} of {r[lane]} was left out: {e}")
                flush()
        finally:
            batch.unpersist()

    return run


class Reloader:
    """Keeps a value that is made from something with versions, such as a stored index. A change is followed by one
    rebuild once it has been quiet for a while; changes during a rebuild lead to one more, never to two at a time. A
    rebuild that fails leaves the value before."""

    def __init__(self, version: Callable, rebuild: Callable, quiet: float = 2.0, poll: float = 0.2):
        self.version, self.rebuild, self.quiet, self.poll = version, rebuild, quiet, poll
        self.built, self.failures = 0, 0
        self.made_from, self.value = version(), rebuild()
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()

    def _watch(self) -> None:
        last, since = self.made_from, None
        while not self._stop.wait(self.poll):
            now = self.version()
            if now != last:
                last, since = now, time.monotonic()
            if since is not None and time.monotonic() - since >= self.quiet:
                since = None
                if last != self.made_from:
                    self._run(last)

    def _run(self, version) -> None:
        try:
            self.value = self.rebuild()
            self.built += 1
        except Exception as e:
            self.failures += 1
            print(f"rebuild failed, the value before stays: {e}")
        self.made_from = version

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()


class Progress(StreamingQueryListener):
    """Writes each batch of each query, and stages that a job reports, to a folder: one small file each, which
    progress_table() reads. Nothing is kept in memory."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.files = Commits(spark, path)

    def _put(self, row: dict) -> None:
        out = self.files.fs.create(self.files.at(f"{time.time_ns()}-{uuid.uuid4().hex[:8]}.json"), False)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def report(self, job: str, stage: str, done: int, total: int) -> None:
        """A stage of a job: how much of it is done."""
        percent = 100.0 * done / total if total else 100.0
        self._put({"job": job, "stage": stage, "batch": None, "rows": done, "percent": percent, "at": time.time()})

    def onQueryStarted(self, event) -> None:
        self._put({"job": event.name or str(event.id), "stage": "started", "batch": None, "rows": 0, "percent": None, "at": time.time()})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._put({"job": p.name or str(p.id), "stage": "batch", "batch": p.batchId, "rows": p.numInputRows, "percent": None, "at": time.time()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put({"job": str(event.id), "stage": "failed" if event.exception else "ended", "batch": None, "rows": 0, "percent": 100.0, "at": time.time()})


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """job, stage, batch, rows, percent, at."""
    return spark.read.schema("job string, stage string, batch long, rows long, percent double, at double").json(path)
