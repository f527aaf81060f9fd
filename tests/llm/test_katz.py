"""The distributed model against a plain one in dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from foliospark.llm import katz


def brute(rows, order=3):
    docs = []
    for i, t in rows:
        raw = (t or "").encode().lower().split()
        docs.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, [*raw, "END"]))
    grams = lambda w, n: zip(*[[*["START"] * (n - 1), *w][k:] for k in range(n)])
    c1, after = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for _, held, w in docs:
        if not held:
            c1.update(w)
            for n in range(2, order + 1):
                for g in grams(w, n):
                    after[n][g[:-1]][g[-1]] += 1
    total, types = sum(c1.values()), len(c1)

    def off(counts):
        n = Counter(counts)
        limit = 6 * n[6] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, 6):
            t = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            d = (t - limit) / (1 - limit) if limit < 1 else 0.0
            out[r] = r * (1 - d) if 0 < d < 1 else 0.5
        return lambda c: out[min(c, 5)]

    off1 = off(c1.values())
    unknown = sum(off1(c) for c in c1.values()) / total if total else 1.0
    offs = {n: off([c for f in after[n].values() for c in f.values()]) for n in range(2, order + 1)}
    alpha = {}

    def p(h, w):
        n = len(h) + 1
        if n == 1:
            return (c1[w] - off1(c1[w])) / total if c1[w] else unknown
        f = after[n].get(h)
        if f is None:
            return p(h[1:], w)
        if f[w]:
            return (f[w] - offs[n](f[w])) / sum(f.values())
        if h not in alpha:
            alpha[h] = sum(offs[n](c) for c in f.values() if c) / sum(f.values()) / (1 - sum(p(h[1:], x) for x, c in f.items() if c))
        return alpha[h] * p(h[1:], w)

    for n in range(2, order + 1):
        for h in list(after[n])[:30]:  # exactly normalised over all words and the unknown one
            assert abs(sum(p(h, w) for w in [*c1, "never seen"]) - 1) < 1e-9
    return [(i, held, len(w), sum(c1[x] > 0 for x in w), total, sum(math.log10((c1[x] + 1) / (total + types + 1)) for x in w), sum(math.log10(p(g[:-1], g[-1])) for g in grams(w, order))) for i, held, w in docs]


def check(spark, rows, **args):
    got = katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), **args).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows, args.get("order", 3)), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, block_bytes=1 << 16)
    # Histories seen a thousand times or more are spread.
    check(spark, rows, block_bytes=1 << 18, bucket_tokens=1000, order=4)


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A b  a"), (3, "A b  a"), (4, "new words\nhere"), (5, " \t"), (10, "a b a b c")]
    rows += [(k, "x y z " * (k % 4)) for k in range(20, 40)]
    for order in (1, 2, 3, 5):
        check(spark, rows, order=order)
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nothing_to_train_on(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = katz.katz_scores(spark.createDataFrame([(k, "a b") for k in ids], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got] == [(3, 0, 0.0, 0.0)] * 3


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "a b c d " * 20_000), (2, "x" * 300_000), (3, " ".join(f"w{k % 977}" for k in range(50_000))), (4, "a b w1 w2"), (10, "c d a w3 " * 500)]
    df = spark.createDataFrame([(*r, 7, "s", 1.0) for r in rows], "doc_id long, text string, g int, words string, score double")
    got = sorted(map(tuple, katz.katz_scores(df, block_bytes=1 << 17).collect()))
    for a, b in zip(got, sorted(brute(rows)), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
