import os
import time

from pyspark.sql import functions as F

from foliospark.operators.commits import Commits
from foliospark.streaming import events, queues
from foliospark.streaming.watching import folder_events, vault_events


def until(check, seconds=60):
    end = time.time() + seconds
    while not check() and time.time() < end:
        time.sleep(0.1)
    assert check()


class Watch:
    def __init__(self, spark, tmp_path, **options):
        self.seen = []
        stream = folder_events(spark, [f"{tmp_path}/in"], f"{tmp_path}/state", **options)
        run = lambda df, _: self.seen.append([(r.path.rpartition("/")[2], r.event, r.size) for r in df.orderBy("modified", "path").collect()])
        self.query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()

    @property
    def events(self):
        return [e for batch in self.seen for e in batch]


def test_folder_events(spark, tmp_path):
    top = tmp_path / "in"
    (top / "a/b/c/d").mkdir(parents=True)
    (top / "old.txt").write_text("there before")
    w = Watch(spark, tmp_path, stability=0.4)
    try:
        until(lambda: os.path.exists(tmp_path / "state/seen/0"))
        time.sleep(0.5)
        (top / "new.md").write_text("one")
        (top / ".hidden.md").write_text("x")
        (top / "image.png").write_text("x")
        (top / "a/b/c/deep.txt").write_text("12")
        (top / "a/b/c/d/deeper.txt").write_text("x")
        until(lambda: len(w.events) == 2)
        assert sorted(w.events) == [("deep.txt", "added", 2), ("new.md", "added", 3)]
        (top / "old.txt").write_text("changed now")
        until(lambda: len(w.events) == 3)
        os.remove(top / "new.md")
        until(lambda: len(w.events) == 4)
        assert w.events[2:] == [("old.txt", "changed", 11), ("new.md", "deleted", 3)]
        # A file that is still being written isn't seen before it rests.
        with open(top / "slow.txt", "w") as f:
            for _ in range(8):
                f.write("x" * 10)
                f.flush()
                time.sleep(0.15)
        until(lambda: len(w.events) == 5)
        assert w.events[4] == ("slow.txt", "added", 80)
    finally:
        w.query.stop()
    # What happens while nobody looks is seen at the next start, and nothing twice.
    os.remove(top / "old.txt")
    (top / "later.html").write_text("y")
    w = Watch(spark, tmp_path, stability=0.4)
    try:
        until(lambda: len(w.events) == 2)
        time.sleep(1)
        assert sorted(w.events) == [("later.html", "added", 1), ("old.txt", "deleted", 12 - 1)]
    finally:
        w.query.stop()


def test_events_beyond_a_batch_wait(spark, tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    for k in range(7):
        (top / f"{k}.txt").write_text("x")
    w = Watch(spark, tmp_path, stability=0, initial="true", mostEvents=3)
    try:
        until(lambda: len(w.events) == 7)
        assert [len(b) for b in w.seen if b] == [3, 3, 1] and len(set(w.events)) == 7
    finally:
        w.query.stop()
    assert vault_events(spark, str(top), f"{tmp_path}/state2").isStreaming


def stream_of(spark, tmp_path, schema):
    (tmp_path / "events").mkdir(exist_ok=True)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/events")


def put(tmp_path, name, *rows):
    (tmp_path / f".{name}").write_text("\n".join(rows))
    os.rename(tmp_path / f".{name}", tmp_path / f"events/{name}")


def test_a_lone_event_fires(spark, tmp_path):
    fired = []
    stream = queues.trailing(stream_of(spark, tmp_path, "key string, at long, what string"), "key", "at", "what", 1500)
    query = stream.writeStream.foreachBatch(lambda df, _: fired.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
    try:
        put(tmp_path, "1.json", '{"key":"a","at":2,"what":"second"}', '{"key":"a","at":1,"what":"first"}', '{"key":"b","at":1,"what":"lone"}')
        put(tmp_path, "2.json", '{"key":"a","at":3,"what":"third"}')
        until(lambda: len(fired) == 2)
        assert sorted(fired) == [("a", "third", 3), ("b", "lone", 1)]
        put(tmp_path, "3.json", '{"key":"b","at":9,"what":"again"}')
        until(lambda: len(fired) == 3)
        assert fired[2] == ("b", "again", 1)
    finally:
        query.stop()


def test_serial_queue(spark, tmp_path):
    got, flushes = [], []

    def ingest(rows):
        paths = [r.path for r in rows.collect()]
        if "bad" in paths:
            raise ValueError("unreadable")
        got.append(paths)

    def start():
        stream = queues.queue(stream_of(spark, tmp_path, "folder string, at long, path string"), "folder", "at", "path", size=3, idle_ms=1500)
        return stream.writeStream.foreachBatch(queues.drain("folder", ingest, lambda: flushes.append(len(got)))).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()

    query = start()
    try:
        put(tmp_path, "1.json", *[f'{{"folder":"f","at":{k},"path":"{k}"}}' for k in (4, 1, 3, 2)])
        until(lambda: len(flushes) == 2)
        assert got == [["1", "2", "3"], ["4"]]  # three at once, the rest when the lane was idle
        put(tmp_path, "2.json", '{"folder":"f","at":5,"path":"5"}', '{"folder":"f","at":6,"path":"bad"}', '{"folder":"f","at":7,"path":"7"}', '{"folder":"f","at":8,"path":"8"}')
        until(lambda: len(flushes) == 4)
        assert got[2:] == [["8"]]  # the flush with the bad file was left out, the next went on
        put(tmp_path, "3.json", '{"folder":"f","at":9,"path":"9"}', '{"folder":"g","at":9,"path":"g9"}')
        time.sleep(0.6)
    finally:
        query.stop()
    # What waited in state is flushed after a restart, in order.
    query = start()
    try:
        until(lambda: len(got) == 5)
        assert sorted(got[3:]) == [["9"], ["g9"]]
    finally:
        query.stop()


def test_reloader(spark, tmp_path):
    commits, built = Commits(spark, f"file://{tmp_path}/c"), []
    commits.put(1, {"x": 1})

    def rebuild():
        time.sleep(0.5)
        number, state = commits.newest()
        if state["x"] == "bad":
            raise ValueError("can't be read")
        built.append(number)
        return state["x"]

    r = queues.Reloader(lambda: commits.newest()[0], rebuild, quiet=0.6, poll=0.05)
    try:
        assert r.value == 1
        commits.put(2, {"x": 2})
        time.sleep(0.2)
        commits.put(3, {"x": 3})
        until(lambda: r.value == 3, 20)
        assert built == [1, 3] and r.built == 1  # two changes in a burst, one rebuild
        commits.put(4, {"x": "bad"})
        until(lambda: r.failures == 1, 20)
        assert r.value == 3
        commits.put(5, {"x": 5})
        until(lambda: r.value == 5, 20)
    finally:
        r.stop()
    assert built == [1, 3, 5]


def test_progress_outlives_recent_progress(spark, tmp_path):
    (tmp_path / "p").mkdir()
    log = queues.Progress(spark, f"file://{tmp_path}/p")
    spark.streams.addListener(log)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = stream_of(spark, tmp_path, "x long")
        for k in range(6):
            put(tmp_path, f"{k}.json", f'{{"x":{k}}}')
        query = stream.writeStream.foreachBatch(lambda df, _: df.count()).queryName("six").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        batches = lambda: queues.progress_table(spark, f"file://{tmp_path}/p").where("job = 'six' and stage = 'batch' and rows > 0")
        until(lambda: batches().count() == 6, 30)
        assert len(query.recentProgress) <= 2 and batches().agg(F.sum("rows")).first()[0] == 6
        log.report("ingest", "chunking", 5, 20)
        assert queues.progress_table(spark, f"file://{tmp_path}/p").where("stage = 'chunking'").first().percent == 25.0
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
        spark.streams.removeListener(log)


def test_batches_see_one_commit(spark, tmp_path):
    from foliospark.operators.store import SCHEMAS, Store

    s = Store(spark, f"file://{tmp_path}/store")
    names = spark.createDataFrame([], SCHEMAS["documents"]).columns
    docs = lambda i: spark.createDataFrame([(i,)], "id string").select(*[F.col(c) if c == "id" else F.lit(None).alias(c) for c in names])
    s.write("documents", docs("a"))
    now = events.latest(spark, s, ["documents", "chunks"])
    s.write("documents", docs("b"))
    # A batch that began before keeps what it began with; the next sees the change.
    assert [r.id for r in now["documents"].collect()] == ["a"] and now["chunks"].count() == 0
    assert [r.id for r in events.latest(spark, s, ["documents"])["documents"].collect()] == ["b"]


def test_counts_by_type(spark):
    rows = [("2024-01-01 00:10:00", "add"), ("2024-01-01 00:50:00", "add"), ("2024-01-01 00:50:00", "unlink"), ("2024-01-01 01:00:00", "add"), ("2024-01-01 01:30:00", None)]
    got = events.counts_by_type(spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts")))
    got = {(r.window.start.hour, r.event_type, r.n) for r in got.select("window", "event_type", "n").collect()}
    assert got == {(0, "add", 2), (0, "unlink", 1), (1, "add", 1), (1, None, 1)}
