import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import alignment as al

TEXTS = ["", None, "Hello world, it's me: we'll", "a" * 3000, " \n\n  x\t \u0085 y  ", "日本語 текст ½ ² ŀ ſ Ω 😀👍🏽 é x².y", "<|endoftext|> <s> </s> <unk> <0x41>", "x " * 2000, "1234567 abc123 9²", "\x00\x1c\x1d odd", "trailing   ", " line　wide", "has ▁ inside", "▁a", " ", "\n", "Hello world, it's me: we'll"]


def brute(texts):
    """Rows by the contract, from the libraries' own calls."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(al.default_tokenizer())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=al.default_pieces())
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    out, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)] if text else []
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append(None)
            continue
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        spans = [[], []]
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, x in tokens:
                spans[side].append((at, at + len(x), i))
                at += len(x)
        groups = [[[(s, e, i) for s, e, i in side if lo <= s < hi] for side in spans] for lo, hi in zip([0, *cuts], cuts)]
        links = Counter((x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[0] < y[1] and y[0] < x[1])
        counts += links
        digest = ";".join("|".join(",".join(str(x[2]) for x in side) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(digest.encode()).hexdigest()))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if r is None else (*r[:3], sum(r[3].values()), sum(n for p, n in r[3].items() if counts[p] == best[p[1]]), sum(n * counts[p] for p, n in r[3].items()), r[4]) for r in out], counts


def test_against_brute_force(spark, sf_dir, tmp_path):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(0, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    want, counts = brute([r[1] for r in rows])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted((tuple(r) for r in al.op13_alignment(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    aligned = spark.createDataFrame(al.align(df).collect(), al._COLUMNS)
    found = al.link_counts(aligned)
    assert {(r.a_id, r.b_id): r.n for r in found.collect()} == dict(counts)
    # Where pairs are too many to broadcast the result is the same.
    joined = lambda most: sorted((tuple(r) for r in al.score(aligned, found, most).collect()), key=key)
    assert joined(0) == joined(1 << 20)
    assert al.align(df.limit(0)).count() == 0


def test_groups_are_bytes_of_the_text(spark):
    rows = list(enumerate(TEXTS))
    got = al.align(spark.createDataFrame(rows, "doc_id long, text string"), with_groups=True).where("row is not null").collect()
    a, b = al.ByteIds(al.default_tokenizer()), al.PieceIds(al.default_pieces())
    table = {i: x for x, i in a.encoding._mergeable_ranks.items()}
    for r in got:
        raw = (" " + (TEXTS[r.doc_id] or "")).encode()
        assert len(r.groups) == r.n_groups
        at = 0
        for g in r.groups:
            assert g.start == at and b"".join(table[i] for i in g.a) == b"".join(b.bytes[i] for i in g.b) == raw[g.start : g.stop]
            at = g.stop
        assert at == (len(raw) if r.n_a else 0)


def test_pieces_are_the_librarys(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=al.default_pieces())
    texts = [t for t in TEXTS if t and "▁" not in t] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for cached in (600_000, 50):
        got = al.PieceIds(al.default_pieces(), cached)([" " + t for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == sp.encode(texts)


def test_a_text_of_megabytes(spark):
    text = "naïve words, 12345 and  more\n" * 60_000 + "a" * 200_000
    rows = spark.createDataFrame([(1, text), (2, text[:1000])], "doc_id long, text string")
    one = al.align(rows).where("row is not null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.aggregate("counts", F.lit(0), lambda x, y: x + y).alias("links")).orderBy("doc_id").collect()
    assert one[0].n_a > 300_000 and all(r.links == r.n_links == r.n_a + r.n_b - r.n_groups for r in one)
