"""Quality by importance resampling.

Hashed counts of words and word pairs make two generative models, one of texts labelled good and one of all
texts. A text's importance is the ratio of its probabilities under them. Gumbel noise on the log
importances and a cut at the k-th largest draw k texts without replacement in proportion to it. k is a
share of all texts.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, raw_texts, table, word_hasher

BUCKETS = 10_000
#: Weight of the raw model in the target's: what few labelled texts have missed is not held to be impossible.
PRIOR = 0.2
#: Added to the share of good texts among the labelled ones where no share to keep is given, so that noise at the
#: cut costs few good ones.
SPARE = 0.02
SEED = 7
#: Up to this many labels are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 1 << 20


def grams(raw: bytes, buckets: int) -> np.ndarray:
    """Buckets of a text's words and pairs of neighbouring words."""
    w = word_hasher()(raw)
    pairs = mix64(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
    return (np.concatenate((w, pairs)) % np.uint64(buckets)).astype(np.intp)


def count_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw, target: counts over all texts of docs (text, good) and over the good ones."""

    def counts(batches):
        import pyarrow as pa

        sums = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            found = [grams(raw, buckets) for raw in raw_texts(batch["text"])]
            good = [x for x, y in zip(found, batch["good"].to_pylist(), strict=True) if y]
            for k, some in enumerate((found, good)):
                if some:
                    sums[k] += np.bincount(np.concatenate(some), minlength=buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(x[at]) for x in sums]], names=["bucket", "raw", "target"])

    return docs.select("text", "good").mapInArrow(counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


class Importance:
    """log (p_target / p_raw) of each bucket, and the share of good texts among those with a label.

    p_raw are the frequencies over all texts, each count raised by one; p_target those over good texts, mixed
    with PRIOR parts of p_raw.
    """

    def __init__(self, ratios: np.ndarray, good_share: float):
        self.ratios, self.good_share = ratios, good_share

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> "Importance":
        """docs (doc_id, text); labels (doc_id, good) without repeats. Without good texts all ratios are 0."""
        marked = labels.select(F.col("doc_id").alias("_labelled"), "good")
        if labels.count() <= BROADCAST_ROWS:
            marked = F.broadcast(marked)
        both = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(marked, F.col("doc_id") == F.col("_labelled"), "left")
        labelled, good = both.agg(F.count("good"), F.count(F.when(F.col("good"), 1))).first()
        if not good:
            return cls(np.zeros(buckets), 1.0)
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for r in count_grams(both, buckets).collect():  # at most one row a bucket
            raw[r.bucket], target[r.bucket] = r.raw, r.target
        p_raw = (raw + 1) / (raw.sum() + buckets)
        p_target = (1 - PRIOR) * target / target.sum() + PRIOR * p_raw if target.any() else p_raw
        return cls(np.log(p_target) - np.log(p_raw), good / labelled)

    def column(self, text):
        """The log importance of a text; 0 for empty texts and null."""
        ratios = self.ratios

        @F.arrow_udf("double")
        def log_importance(texts):
            import pyarrow as pa

            return pa.array([float(ratios[grams(raw, len(ratios))].sum()) for raw in raw_texts(texts)], pa.float64())

        return log_importance(text.cast("string"))


def gumbel(seed: int):
    """Standard Gumbel noise that depends on doc_id and seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) * 2.0**-53
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest value of a long column, by histograms of ever narrower ranges; None if there are fewer."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None if low is None else high + 1
    left = k
    while True:
        width = max(1, -(-(high - low + 1) // bins))
        inside = df.where(F.col(column).between(low, high)).groupBy(F.expr(f"cast(({column} - ({low})) div {width} as int)").alias("bin")).count()
        found = sorted(((r["bin"], r["count"]) for r in inside.collect()), reverse=True)  # at most bins rows
        for at, n in found:
            if n >= left:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            left -= n
        else:
            return None
        if width == 1:
            return low


def _key(log_importance, seed: int):
    """Fixed point: keys are compared as whole numbers of millionths."""
    return F.round(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), log_importance + gumbel(seed))) * 1e6).cast("long")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, buckets: int = BUCKETS):
    """(scores, keep): scores has doc_id, log_importance, gumbel_key and kept for each row of docs
    (doc_id, text); keep(docs) filters rows by the same cut and leaves their columns as they are.

    k is share times the rows of docs; by default the share of good texts among labelled ones, and SPARE.
    labels (doc_id, good) tells good texts from bad ones; where an id has several, one good one is enough,
    and null ids and labels don't count. Null and empty texts have importance 1. Rows that repeat an id
    share their noise; rows at the cut all stay. Without good texts nothing is rejected; an empty table
    gives an empty result. Columns of docs other than doc_id and text are not read.
    """
    labels = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    scratch = Scratch(docs.sparkSession)
    model = Importance.fit(docs, scratch.write("labels", labels), buckets)
    scores = docs.select("doc_id", model.column(F.col("text")).alias("log_importance"))
    scores = scratch.write("scores", scores.withColumn("gumbel_key", _key(F.col("log_importance"), seed)))
    share = min(1.0, model.good_share + SPARE) if share is None else share
    cut = kth_largest(scores, "gumbel_key", math.ceil(round(share * scores.count(), 6)))
    kept = lambda key: key >= F.lit(cut) if cut is not None else F.lit(True)

    def keep(d: DataFrame) -> DataFrame:
        return d.where(kept(_key(model.column(F.col("text")), seed)))

    return scores.withColumn("kept", kept(F.col("gumbel_key"))), keep


def quality_labels(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))


def op3_quality_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))[0]
