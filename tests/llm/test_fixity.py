import hashlib

from pyspark.sql import functions as F

from foliospark.llm import fixity


def bad(spark, rows, changed, lost, surplus=()):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    held = fixity.manifest(pages)
    key = F.concat_ws("-", "shard", "seq")
    replica = held.where(~key.isin(lost)).withColumn("digest", F.when(key.isin(changed), F.lit("0")).otherwise(F.col("digest")))
    replica = replica.union(spark.createDataFrame([(s, q, 7, 0, 9, "new") for s, q in surplus], replica.schema))
    found = fixity.audit(held, replica).collect()
    assert {f"{r.shard}-{r.seq}" for r in found if r.replica_digest is None} == set(lost)
    assert {(r.shard, r.seq) for r in found if r.digest is None and r.page_id == 7} == set(surplus)
    return sorted(f"{r.shard}-{r.seq}" for r in found), held.collect()


def test_finds_exactly_what_differs(spark):
    rows = [(k, f"http://x/{k}", "é" * (k % 50), "clash") for k in range(0, 9000, 3)] + [(None, None, None, None), (3, "http://x/3", "again", None), (3, "http://x/3", "again", None)]
    changed, lost = ["0-0", "0-5", "3-17", "8-100"], ["-1-0", "2-340"]
    found, held = bad(spark, rows, changed, lost, [(0, 900), (12, 3)])
    assert found == sorted([*changed, *lost, "0-900", "12-3"])
    assert len({(r.shard, r.seq) for r in held}) == len(held)
    assert len(held) == len(rows)
    shard = sorted((r for r in held if r.shard == 0), key=lambda r: r.seq)
    assert [r.offset for r in shard] == [sum(x.length for x in shard[:k]) for k in range(len(shard))]
    body = "é" * 9
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nWARC-Target-URI: http://x/9\r\nContent-Type: text/html\r\nContent-Length: 18\r\n\r\n{body}\r\n\r\n"
    assert hashlib.sha256(record.encode()).hexdigest() in {r.digest for r in held}


def test_equal_replicas_and_empty_tables(spark):
    assert bad(spark, [(k, "u", "h", None) for k in range(40)], [], [])[0] == []
    assert bad(spark, [], [], [])[0] == []
    assert bad(spark, [(5, "u", "h", None)], ["0-0"], [])[0] == ["0-0"]


def test_many_open_nodes(spark, monkeypatch):
    monkeypatch.setattr(fixity, "NARROW", 3)
    rows = [(k, "u", "h" * (k % 9), None) for k in range(3000)]
    changed = [f"{k >> 10}-{k & 1023}" for k in range(0, 3000, 37)]
    assert bad(spark, rows, changed, [])[0] == sorted(changed)


def test_one_id_for_most_records_and_long_pages(spark):
    rows = [(7, f"u{k % 5}", f"text {k % 11}", None) for k in range(700)] + [(None, "u", f"n{k}", None) for k in range(300)] + [(k, "u", "x" * 3_000_000, None) for k in range(2)]
    found, held = bad(spark, rows, ["0-17", "-1-250"], ["0-600"])
    assert found == ["-1-250", "0-17", "0-600"]
    for shard in (0, -1):
        mine = sorted((r for r in held if r.shard == shard), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(mine)))
        assert [r.offset for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]


def test_query_on_repeated_and_null_ids(spark, tmp_path):
    fates = {k: hashlib.md5(str(k).encode()).hexdigest()[:2] for k in range(3000)}
    rows = [(k, f"u{k}", "<p>page</p>") for k in fates] + [(k, f"again{k}", "<p>other</p>") for k in range(0, 3000, 2)] + [(None, "u", "<p>x</p>")] * 3
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = fixity.op1_fixity_audit(spark, str(tmp_path)).collect()
    want = sorted((i, fates[i] == "0e") for i, _, _ in rows if i is not None and fates[i] in ("0d", "0e"))
    assert sorted((r.page_id, r.replica_digest is None) for r in got) == want and len({w[1] for w in want}) == 2
