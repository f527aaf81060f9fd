"""Sources, sinks, services and streams on small files."""

import datetime
import json
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from foliospark.plans import service
from foliospark.sources import archive, audit, bibliography, exports, files, workspaces
from foliospark.streaming import events


def database(path, tables, rows):
    db = sqlite3.connect(path)
    for name, schema in tables.items():
        db.execute(f'CREATE TABLE "{name}" ({", ".join(f"{c.split()[0]}" for c in schema.split(", "))})')
        for r in rows.get(name, []):
            db.execute(f'INSERT INTO "{name}" VALUES ({",".join("?" * len(r))})', r)
    db.commit()
    db.close()


def test_bibliography(spark, tmp_path):
    rows = {
        "libraries": [(1, "user"), (2, "group"), (3, "feed")], "groups": [(2, "Team")],
        "collections": [(1, "Top", "T", None, 1), (2, "Sub", "S", 1, 1)], "collectionItems": [(2, 10)],
        "items": [(10, "I10", 1, 1, "2024-01-02", ""), (11, "I11", 1, 2, "2024-01-03", ""), (12, "I12", 2, 1, "2024", ""), (13, "I13", 1, 1, "2024", ""), (14, "P14", 2, 1, "2024", "")],
        "itemTypes": [(1, "book"), (2, "attachment")], "deletedItems": [(13,)],
        "itemData": [(10, 1, 1), (10, 2, 2)], "fields": [(1, "title"), (2, "date")], "itemDataValues": [(1, "A Book"), (2, "1999")],
        "itemCreators": [(10, 1, 1, 1), (10, 2, 1, 0)], "creators": [(1, "Ann", "Lee"), (2, None, "Bo")], "creatorTypes": [(1, "author")],
        "itemTags": [(10, 1)], "tags": [(1, "History")], "itemAttachments": [(14, 10, "application/pdf", "storage:a.pdf", 0)],
    }
    database(tmp_path / "b.sqlite", bibliography.TABLES, rows)
    b = bibliography.Bibliography.open(spark, f"file://{tmp_path}/b.sqlite")
    assert [(r.libraryID, r.name) for r in b.libraries().collect()] == [(2, "Team"), (1, "My Library")]
    assert [(r.key, r.parentKey) for r in b.collections().collect()] == [("S", "T"), ("T", None)]
    assert [r.libraryID for r in bibliography.for_display(b.libraries()).collect()] == [1, 2]
    names = spark.createDataFrame([(n,) for n in ("Zola", "zone", "Étude", "etat", "Eau", "ça", "Cb")], "name string")
    assert [r.name for r in bibliography.for_display(names).collect()] == ["ça", "Cb", "Eau", "etat", "Étude", "Zola", "zone"]
    items = b.items().collect()
    assert [(r.key, r.title) for r in items] == [("I11", "Untitled"), ("I10", "A Book")]
    book = items[1]
    assert [(c.first, c.last) for c in book.creators] == [("", "Bo"), ("Ann", "Lee")] and book.tags == ["History"] and book.collection_keys == ["S"] and book.fields["date"] == "1999"
    assert items[0].creators == [] and items[0].tags == []
    assert [r.key for r in b.items(collection="S").collect()] == ["I10"] and [r.key for r in b.items(library=2).collect()] == ["I11"]
    assert b.items().where("key = 'I10'").select(bibliography.pdf_path(F.col("attachments"), "/data")).first()[0] == "/data/storage/P14/a.pdf"
    assert [r.key for r in service.search_items(b.items(), query="book", author="lee", year="99", tags=["history"]).collect()] == ["I10"]
    assert [r.key for r in service.search_items(b.items(), collection="su", library="my lib").collect()] == ["I10"]
    assert service.search_items(b.items(), collection="top").isEmpty() and [r.key for r in service.search_items(b.items(), library="team").collect()] == ["I11"]
    assert b.library_of("I11").first().name == "Team" and b.collection_names(["T"]).first().name == "Top"


def test_live_database_with_a_log(spark, tmp_path):
    """What a program that is still running has written to the log only is read too."""
    path = tmp_path / "live.sqlite"
    database(path, bibliography.TABLES, {"libraries": [(1, "user")]})
    live = sqlite3.connect(path)
    live.execute("PRAGMA journal_mode=WAL")
    live.execute("INSERT INTO libraries VALUES (2, 'group')")
    live.execute("INSERT INTO groups VALUES (2, 'Late')")
    live.commit()
    assert (tmp_path / "live.sqlite-wal").stat().st_size > 0
    got = bibliography.Bibliography.open(spark, f"file://{path}").libraries().collect()
    assert [(r.libraryID, r.name) for r in got] == [(2, "Late"), (1, "My Library")]
    live.close()


def test_archive(spark, tmp_path):
    dc = "http://purl.org/dc/elements/1.1/"
    rows = {
        "project": [("P",)], "items": [(1,), (2,), (3,)], "subjects": [(1, "t", "x"), (2, "t", "x"), (3, "t", "x")], "trash": [(3,)],
        "metadata": [(1, dc + "title", 1), (1, dc + "date", 2), (1, "http://x/box", 3)], "metadata_values": [(1, "Letter"), (2, "1901"), (3, "7")],
        "tags": [(1, "red")], "taggings": [(1, 1)], "notes": [(1, 1, "<p>a &amp; b</p>", "", None, None), (2, 1, "gone", "", "fr", "x")],
        "photos": [(5, 1, "img/a.jpg", "file", "", "a.jpg", 0, 2), (6, 1, "/abs.jpg", "file", "", "b.jpg", 0, 1)], "transcriptions": [(1, 5, "said", 0, None)],
    }
    database(tmp_path / "project.tpy", archive.TABLES, rows)
    a = archive.Archive.open(spark, f"file://{tmp_path}")
    got = {r.id: r for r in a.items().collect()}
    assert set(got) == {1, 2} and got[1].title == "Letter" and got[2].title == "Item 2"
    assert got[1].content == "Letter\n\nDate: 1901\n\nbox: 7\n\na & b\n\nsaid"
    assert [p.path.rpartition("/")[2] for p in got[1].photos] == ["abs.jpg", "a.jpg"] and got[1].notes[0].language == "en"
    s = a.statistics().first()
    assert (s["items"], s.with_notes, s.with_photos) == (2, 1, 1) and a.name().first()[0] == "P" and [r[0] for r in a.all_tags().collect()] == ["red"]


def test_files_and_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "a.txt").write_text("plain words here")
    (tmp_path / "b.md").write_text("# T\nplain *x*")
    (tmp_path / "sub" / "c.html").write_text("<title>C</title><p>hi</p>")
    (tmp_path / "d.txt").write_text("plain words here")
    (tmp_path / "e.bin").write_text("x")
    found = files.scan(spark, f"file://{tmp_path}")
    read = {r.path.rpartition("/")[2]: r for r in files.extract(found).collect()}
    assert set(read) == {"a.txt", "b.md", "c.html", "d.txt"} and read["b.md"].text == "T\nplain x" and read["c.html"].title == "C"
    documents, chunks, state = service.ingest(found, spark.createDataFrame([], "file_hash string"))
    assert sorted(r.status for r in state.collect()) == ["ingested", "ingested", "ingested", "skipped"]
    assert documents.count() == 3 and chunks.count() == 3
    again = service.ingest(found, documents.select("file_hash"))
    assert again[0].count() == 0
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian" / "x.md").write_text("no")
    (tmp_path / "sub" / "draft.md").write_text("no")
    assert [r.relative_path for r in files.scan_vault(spark, f"file://{tmp_path}", ["draft.md"]).collect()] == ["b.md"]


def test_pages_of_pdf_files_and_one_note(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "Paper.PDF").write_text("  One  a|b ~Two")
    (tmp_path / "n.md").write_text("# N\ntext")

    def reader(content):
        pages = F.transform(F.split(content.cast("string"), "~"), lambda p, i: F.struct((i + 1).alias("number"), F.split(p, r"\|").alias("items")))
        return F.struct(pages.alias("pages"), F.struct(F.lit(" ").alias("title"), F.lit("Ann").alias("author")).alias("info"))

    documents, pages = files.extract_pages(files.scan(spark, f"file://{tmp_path}"), reader)
    d = documents.first()
    assert (d.title, d.author, d.page_count, d.text) == ("Paper", "Ann", 2, "One a b\n\nTwo")
    assert [(r.page_number, r.text) for r in pages.orderBy("page_number").collect()] == [(1, "One a b"), (2, "Two")]
    assert files.read_note(spark, f"file://{tmp_path}", "n.md").first().body == "# N\ntext"


def test_audit_log(spark, tmp_path):
    folder = f"{tmp_path}/log"
    for k, kind in enumerate(("tool", "resource", "prompt")):
        audit.append(spark.createDataFrame([(f"2024-01-0{k + 1}", kind, f"n{k}", "{}")], "timestamp string, type string, name string, input string"), folder)
    (tmp_path / "log" / "bad.json").write_text("not json\n")
    log = audit.read(spark, folder)
    assert [r.name for r in audit.tail(log, 2).collect()] == ["n2", "n1"] and audit.status(log).first().n == 3


def test_workspaces(spark, tmp_path):
    for n in ("one", "two"):
        workspaces.create(spark, f"file://{tmp_path}/{n}", workspaces.Workspace(n, lastOpenedAt=n))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "workspace.json").write_text("{")
    (tmp_path / "old" / ".workspace").mkdir(parents=True)
    (tmp_path / "old" / ".workspace" / "config.json").write_text(json.dumps({"name": "old", "language": "fr"}))
    assert workspaces.load(spark, f"file://{tmp_path}/old").language == "fr"
    assert [r.name for r in workspaces.listing(spark, f"file://{tmp_path}/*/workspace.json").collect()] == ["two", "one"]
    try:
        workspaces.load(spark, f"file://{tmp_path}/none")
        raise AssertionError
    except FileNotFoundError as e:
        assert "No workspace found" in str(e)


def test_exports(spark, tmp_path):
    row = spark.createDataFrame([("Why?", "Because.", ["A - (1999)"])], "q string, a string, r array<string>")
    body = row.select(exports.exchange(F.col("q"), F.col("a"), F.col("r"), F.lit("2024-01-01"))).first()[0]
    assert body.startswith('---\ntitle: "Why?"\ndate: 2024-01-01\n') and "1. A - (1999)" in body
    exports.write_notes(spark.createDataFrame([("n.md", body)], "file_name string, body string"), f"{tmp_path}/out")
    assert (tmp_path / "out/n.md").read_text() == body


def test_notes_keep_what_is_there(spark, tmp_path):
    top = tmp_path / "vault"
    (top / "sub").mkdir(parents=True)
    for name, text in {"mine.md": "mine", "a.md": "old a", "a-2.md": "old a-2", "sub/x.md": "deep", "b-1.md": "old b-1"}.items():
        (top / name).write_text(text)
    before = {str(p.relative_to(top)): p.read_text() for p in top.rglob("*.md")}
    rows = [(1, "a.md", "first"), (2, "a.md", "second"), (3, "a.md", "third"), (4, "b.md", "b"), (5, "b.md", "bb"), (6, "a-4.md", "its own name"), (7, "new.md", "né\n"), (8, "new.md", None)]
    notes = spark.createDataFrame(rows, "at int, file_name string, body string").repartition(3)
    named = {r["at"]: r.file_name for r in exports.write_notes(notes, str(top), ["at"]).collect()}
    assert named == {1: "a-1.md", 2: "a-3.md", 3: "a-5.md", 4: "b.md", 5: "b-2.md", 6: "a-4.md", 7: "new.md", 8: "new-1.md"}
    after = {str(p.relative_to(top)): p.read_text() for p in top.rglob("*") if p.is_file()}
    assert {k: after[k] for k in before} == before
    assert {k: v for k, v in after.items() if k not in before} == {named[at]: body or "" for at, _, body in rows}
    # A second run adds further files; nothing is changed.
    exports.write_notes(notes.where("at in (1, 7)"), f"file://{top}", ["at"])
    again = {str(p.relative_to(top)): p.read_text() for p in top.rglob("*") if p.is_file()}
    assert {k: again[k] for k in after} == after and {k for k in again if k not in after} == {"a-6.md", "new-2.md"}


def test_a_task_that_runs_again_writes_nothing_twice(tmp_path):
    writer = exports.NoteWriter({"path": str(tmp_path)})
    rows = [{"file_name": "a.md", "body": "x"}, {"file_name": "b.md", "body": "y"}]
    assert writer.write(iter(rows)).n == 2 and writer.write(iter(rows)).n == 0
    (tmp_path / "b.md").write_text("somebody else's")
    with pytest.raises(FileExistsError):
        writer.write(iter(rows))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.md", "b.md"] and (tmp_path / "b.md").read_text() == "somebody else's"
    with pytest.raises(ValueError):
        writer.write(iter([{"file_name": "../a.md", "body": "x"}]))


def test_places_within_a_common_stem(spark):
    rows = [("export", k) for k in range(500)] + [("other", 3), ("other", 1), (None, 1)]
    got = exports.places(spark.createDataFrame(rows, "stem string, k int").repartition(5), "stem", ["k"]).collect()
    assert sorted((r.k, r.place) for r in got if r.stem == "export") == [(k, k) for k in range(500)]
    assert sorted((r.stem or "", r.k, r.place) for r in got if r.stem != "export") == [("", 1, 0), ("other", 1, 0), ("other", 3, 1)]


def test_debounce_case(spark):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    df = spark.createDataFrame([(1, "k", at(ms)) for ms in (0, 100, 350, 900)], "id int, key string, ts timestamp")
    fired = [r.fires_at for r in events.debounce(df, "ts", "key", "300 milliseconds", "id").orderBy("fires_at").collect()]
    assert fired == [at(650), at(1200)]


def test_debounce_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "id int, key string, ts timestamp"
    spark.createDataFrame([(1, "k", at(0)), (2, "k", at(1))], schema).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(3, "k", at(1000))], schema).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = events.debounce_stream(stream, "ts", "key", "5 seconds", "id", "1 second").writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.key, r.last_event, r.n) for r in spark.sql("select * from fired").collect()] == [("k", 2, 2)]


def test_watch_and_snapshots(spark, tmp_path):
    top = tmp_path / "w"
    top.mkdir()
    (top / "a.txt").write_text("a")
    (top / "z.bin").write_text("z")
    before = spark.createDataFrame(events.snapshot(spark, f"file://{top}", ("txt",)).collect())
    seen = []
    q = events.ingest_stream(events.watch(spark, f"file://{top}", ("txt",)), lambda df, _: seen.extend(r.path.rpartition("/")[2] for r in df.collect()), f"{tmp_path}/c", "100 milliseconds")
    q.processAllAvailable()
    (top / "b.txt").write_text("b")
    time.sleep(0.2)
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a.txt", "b.txt"]
    (top / "a.txt").unlink()
    got = {r.path.rpartition("/")[2]: r.event for r in events.changes(before, events.snapshot(spark, f"file://{top}", ("txt",))).collect()}
    assert got == {"a.txt": "unlink", "b.txt": "add"}


def test_agent_loop():
    said = iter(['{"thought": "look", "action": "search", "action_input": "q"}', '{"answer": "done"}'])
    agent = service.Agent(lambda prompt: next(said), {"search": lambda q: ("found", [{"chunk_id": "1"}, {"chunk_id": "1"}])})
    got = agent.run("why")
    assert got == {"answer": "done", "calls": [("search", "q")], "sources": [{"chunk_id": "1"}]}
    assert service.Agent(lambda p: "plain").run("x")["answer"] == "plain"
    assert len(service.Agent(lambda p: '{"action": "t"}', {"t": lambda q: ("", [])}).run("x")["calls"]) == 5
