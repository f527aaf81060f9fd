import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import quality as q
from foliospark.llm.common import mix64, word_hasher


def brute(docs, labels, buckets):
    def grams(t):
        w = [word_hasher()(x)[0] for x in (t or "").encode().lower().split()]
        pairs = [mix64(np.array([a * np.uint64(0x9E3779B97F4A7C15) + b]))[0] for a, b in zip(w, w[1:])]
        return [int(x % np.uint64(buckets)) for x in [*w, *pairs]]

    good = {}
    for i, y in labels:
        if i is not None and y is not None:
            good[i] = max(y, good.get(i, False))
    raw = Counter(g for _, t in docs for g in grams(t))
    target = Counter(g for i, t in docs if good.get(i) for g in grams(t))
    p_raw = {k: (raw[k] + 1) / (sum(raw.values()) + buckets) for k in range(buckets)}
    p_target = {k: (1 - q.PRIOR) * target[k] / sum(target.values()) + q.PRIOR * p_raw[k] for k in p_raw}
    share = sum(good.get(i, False) for i, _ in docs) / sum(i in good for i, _ in docs)
    return [sum(math.log(p_target[g] / p_raw[g]) for g in grams(x)) for _, x in docs], share


def test_importances_and_cut(spark):
    with np.errstate(over="ignore"):
        docs = [(k, ("good words flow here " * (1 + k % 3)) if k % 4 else "spam spam spam | spam ") for k in range(80)] + [(None, None), (200, ""), (3, "good words"), (3, "good words")]
        labels = [(k, k % 4 != 0) for k in range(0, 80, 3)] + [(None, True), (5, None), (0, False)]
        df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, kept double")
        lab = spark.createDataFrame(labels, "doc_id long, good boolean")
        scores, keep = q.resample(df, lab, buckets=500)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.log_importance) for r in scores.collect())
        logs, share = brute(docs, labels, 500)
        want = sorted((i is None, i or 0, x) for (i, _), x in zip(docs, logs))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want))
        keys = sorted((r.gumbel_key for r in scores.collect()), reverse=True)
        k = math.ceil((share + q.SPARE) * len(docs))
        assert {r.kept for r in scores.where(F.col("gumbel_key") >= keys[k - 1]).collect()} == {True}
        assert scores.where("kept").count() == sum(x >= keys[k - 1] for x in keys)
        assert keep(df).count() == scores.where("kept").count()
        same = df.withColumn("log_importance", F.lit("mine")).withColumn("gumbel_key", F.lit(7))
        assert keep(same).columns == same.columns and {(r.log_importance, r.gumbel_key) for r in keep(same).collect()} == {("mine", 7)}
        assert q.resample(df, lab, share=0.25, buckets=500)[0].where("kept").count() == len(docs) // 4


def test_without_labels_all_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, good boolean")
    assert q.resample(df, none)[0].where("kept").count() == 2
    assert q.resample(df.limit(0), none)[0].count() == 0


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "good words " * 300_000), (2, "good words"), (3, "x" * 2_000_000)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, True), (3, False)], "doc_id long, good boolean")
    got = {r.doc_id: r.log_importance for r in q.resample(df, lab)[0].collect()}
    assert got[1] > 0 > got[3] and all(map(math.isfinite, got.values()))


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    x = [int(v) for v in rng.integers(-(10**15), 10**15, 2000)] + [7] * 50
    df = spark.createDataFrame([(v,) for v in x], "v long")
    for k in (1, 2, 1000, 1030, 2050):
        assert q.kth_largest(df, "v", k, bins=64) == sorted(x, reverse=True)[k - 1]
    assert q.kth_largest(df, "v", 2051) is None


def test_clean_documents_stay(spark):
    """Some thousand labels are enough for models that tell good texts, also those that they haven't seen, from bad ones."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    taught = labels.where("half = 0").select("doc_id", (F.col("quality") == 1).alias("good"))
    scores = q.resample(spark.read.parquet(f"{d}/documents.parquet"), taught)[0].join(labels, "doc_id")
    r = {(x.half, x.quality): x.k for x in scores.groupBy("half", "quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert r[0, 1] > 0.99 and r[1, 1] > 0.97 and r[0, 0] < 0.25 and r[1, 0] < 0.3
