import itertools
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from foliospark.llm import toxicity as t
from foliospark.llm.common import crc32_of_id


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = t.op5_toxicity(spark, d)
    assert got.count() == 10_000 and got.where("score < 0 or score > 1 or score is null").isEmpty()
    assert got.where("(score >= 0.3) <> (predicted = 1)").isEmpty()
    x = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    tp, p, y = x.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert tp >= 0.85 * y and tp >= 0.85 * p


def test_odd_rows(spark):
    docs = [(k, "you absolute gronk " * 3 if k % 2 else "a quiet day by the sea") for k in range(400)] + [(None, None), (500, ""), (501, "G.R.O.N.K you"), (1, "you absolute gronk")]
    labels = [(k, k % 2) for k in range(400)] + [(None, 1), (2, None), (3, 0)]
    df = spark.createDataFrame([(i, x, "c") for i, x in docs], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = crc32_of_id(F.col("doc_id")) % 4 == 2
    got = t.toxicity(df, lab, held).collect()
    assert len(got) == len(docs)
    right = [r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) >= 0.95 * len(right)
    one = t.toxicity(df, lab.where("toxic = 0"), held).collect()
    assert {(r.score, r.predicted) for r in one} == {(0.0, 0)}
    assert t.toxicity(df.limit(0), lab, held).count() == 0 and t.toxicity(df, lab.limit(0), held).count() == len(docs)


def test_features_see_hidden_words():
    lex = t.Lexicon({b"idiot"}, {b"moro"})
    f = lambda s: dict(zip(t.FEATURES, lex.features(s.encode()), strict=True))
    assert f("You IDIOT!")["word_hits"] == 1 and f("You IDIOT!")["near_you"] > 0
    assert f("an id1ot")["hidden_hits"] == 1 and f("i.d.i.o.t")["hidden_hits"] == 1 and f("morons")["start_hits"] == 1
    assert f("")["word_hits"] == 0


def plain_features(text, words, starts):
    """The features, each from its definition."""
    raw, low = text.encode(), text.encode().lower()
    cut = re.split(rb"[\x00-\x20!-/:-@[-`{-~\x7f]+", low)
    cut = [w for w in cut if w]
    n, size = max(1, len(cut)), max(1, len(raw))
    begins = lambda w: any(len(w) > len(x) and w.startswith(x) for x in starts)
    exact, begun, you = ([f(w) for w in cut] for f in (lambda w: w in words, begins, lambda w: w in t.SECOND))
    near = sum((exact[i] or begun[i]) and any(you[max(0, i - 5) : i + 6]) for i in range(len(cut)))
    runs = re.findall(rb"[a-z0-9@$!]+", low)
    hidden = [w.translate(t.LEET) for w in runs if re.search(rb"[a-z][0-9@$!]+[a-z]", w)]
    hidden += [bytes(c for c in m if 97 <= c <= 122) for m in re.findall(rb"(?<![a-z])(?:[a-z][ .*_-]){3,}[a-z](?![a-z])", low)]
    count = lambda test: sum(map(test, raw))
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    longest = max((len(list(g)) for _, g in itertools.groupby(cut)), default=0)
    return [
        math.log1p(len(cut)), sum(exact), sum(exact) / n, sum(begun), sum(begun) / n, near / n, sum(you) / n, sum(w in words or begins(w) for w in hidden), len(hidden) / n,
        count(lambda c: 65 <= c <= 90) / max(1, count(letter)), len(re.findall(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])", raw)) / n, raw.count(b"!") / n, raw.count(b"?") / n,
        count(lambda c: 33 <= c < 127 and not chr(c).isalnum()) / size, count(lambda c: 48 <= c <= 57) / size, len(re.findall(rb"([a-z])\1\1", low)) / n, sum(map(len, cut)) / n, longest / n,
    ]


def test_features_by_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", "YOU id1ot!! sooo b@d, i d i o t s", "a1a 1a1 a!b@c $x$ 0o0o0"]
    seen = Counter(w for x in texts for w in set(x.encode().lower().split()) if w.isalpha())
    words, starts = {w for w, n in seen.items() if n % 7 == 3}, {w[:4] for w, n in seen.items() if n % 5 == 2 and len(w) > 4} | {w[:6] for w, n in seen.items() if n % 5 == 3 and len(w) > 6}
    lexicon = t.Lexicon(words, starts)
    for x in texts:
        assert lexicon.features(x.encode()) == pytest.approx(plain_features(x, words, starts), abs=1e-12), x


def test_isotonic_step_by_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.random(), 0.0) for _ in range(300)]
    pairs = [(x, float(rng.random() < x)) for x, _ in pairs]
    blocks = []
    for x, y in sorted(pairs):
        blocks.append([y, 1, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    want = {x: s / n for s, n, xs in blocks for x in xs}
    df = spark.createDataFrame(pairs, "raw double, label double")
    got = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(df).transform(df).collect()
    assert all(abs(r.score - want[r.raw]) < 1e-9 for r in got)


def test_long_texts_take_linear_time():
    lexicon = t.Lexicon({b"idiot"}, {b"moro"})
    for x in ("a" * 1_000_000, "a1" * 500_000, "1" * 1_000_000, "a.b." * 250_000, "AB" * 500_000, "a" + "1" * 1_000_000, "you idiot " * 100_000):
        began = time.time()
        lexicon.features(x.encode())
        assert time.time() - began < 10
