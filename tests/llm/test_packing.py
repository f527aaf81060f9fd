import zlib

import numpy as np
import pytest

from foliospark.llm import packing as p

TEXTS = ["", None, "Hello world, it's me: we'll they've 've 'S don't", "a" * 5000, " \n\n  x\t \u0085 y  ", "日本語 текст ½ ² ŀ ſ Ω 😀👍🏽 é", "<|endoftext|> ordinary", "x " * 2000, "1234567 abc123 9²", "\x00\x1c\x1d odd", "trailing   ", " line　wide"]


def hf_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.default_tokenizer())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers(spark, sf_dir):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = p.Ids(p.default_tokenizer(), cached=100)
    for text, want in zip(texts, hf_ids(texts), strict=True):
        assert np.frombuffer(ids(text or ""), "<u4").tolist() == want


def test_pieces(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = p.pack(df, with_ids=True).collect()
    want = sorted(zip([r[0] if r[0] is not None else -1 for r in rows], [[*i, 0] for i in hf_ids([r[1] for r in rows])]))
    docs, one = [], []
    for r in sorted(got, key=lambda r: r.sequence_id):
        assert r.length == len(r.ids) == 2**r.bucket <= 1024 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        assert r.start == len(one)
        one += r.ids
        if len(one) == r.doc_tokens:
            docs.append((r.doc_id if r.doc_id is not None else -1, one))
            one = []
    assert sorted(docs) == want and not one
    assert len({r.sequence_id for r in got}) == len(got)
    assert p.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        p.pack(df, max_len=1000)


def test_added_tokens_are_found_in_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.default_tokenizer())
    texts = [x or "" for x in TEXTS] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>日本 ", " <|endoftext", "  \n<|endoftext|>\n  it's"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[len(TEXTS)] == [64, 220, 50256, 275]
    ids = p.Ids(p.default_tokenizer(), added_tokens=True)
    assert [np.frombuffer(ids(x), "<u4").tolist() for x in texts] == want
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in p.op10_packing(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for k, x in enumerate(want):
        raw = np.array([*x, p.END_ID], dtype="<u4").tobytes()
        assert all((zlib.crc32(raw[4 * a : 4 * (a + n)]), len(x) + 1) == (crc, total) for a, n, crc, total in got[k])
        assert sum(r[1] for r in got[k]) == len(x) + 1
