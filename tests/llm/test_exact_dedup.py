import hashlib
import random

from foliospark.llm import exact_dedup as ed


def low(t):
    return (t or "").encode().lower()


def check(spark, rows, **args):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = ed.exact_dedup(df, **args).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    key = lambda i: (i is not None, i or 0)
    want = sorted((key(i), hashlib.sha256(low(t)).hexdigest(), key(max(groups[low(t)], key=key)), len(groups[low(t)])) for i, t, _ in rows)
    assert sorted((key(r.doc_id), r.text_sha256, key(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_odd_rows(spark):
    rows = [(1, "Ab"), (2, "aB"), (2, "aB"), (None, "ab"), (None, None), (3, ""), (4, None), (5, "É"), (6, "é"), (7, "ab ")]
    check(spark, [(i, t, "x") for i, t in rows])
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_huge_texts_are_hashed_in_parts(spark):
    rng = random.Random(0)
    base = "".join(rng.choice("abcdefgh ") for _ in range(9_000_000))
    rows = [(1, base), (2, base.upper()), (3, base[:-1] + "x"), (4, "y" + base[1:]), (5, base + " "), (6, "short"), (7, "SHORT")]
    check(spark, [(i, t, None) for i, t in rows], huge=1 << 20)
    powers = ed._powers()
    whole = ed.terms(base.encode(), 0, powers)
    cut = ed.CHUNK * 64
    parts = [ed.terms(base[at : at + cut].encode(), max(0, len(base) - at - cut), powers) for at in range(0, len(base), cut)]
    assert [sum(p[k] for p in parts) % ed.PRIMES[k] for k in (0, 1)] == whole


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    # With a modulus of 3 most texts of one length collide.
    monkeypatch.setattr(ed, "PRIMES", (3, 3))
    check(spark, [(k, "abcdefgh"[k % 8] + "bcdefgha"[k % 5], None) for k in range(60)])


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
