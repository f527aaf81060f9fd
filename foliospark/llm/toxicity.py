"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is mined from labelled texts of one part of the training rows;
trees are grown on a second part, so that they see the lexicon as new texts do, and scores are
calibrated on a third. Features are densities of lexicon hits, their nearness to second-person words,
and rates of capitals, punctuation and obfuscation.
"""

import re
from collections import Counter

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc32_of_id, raw_texts, table

#: Labelled rows that the models are fitted on, at most (a random part beyond).
MOST_ROWS = 40_000
#: Words and word beginnings in the lexicon, at most of each.
LEXICON = 400
CUT = 0.3
#: Up to this many labels are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 1 << 20

# Words for the person addressed.
SECOND = frozenset(x.encode() for x in "you your yours yourself u ur thou du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
# Characters often put for letters.
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")

FEATURES = ["log_words", "word_hits", "word_density", "start_hits", "start_density", "near_you", "you_density", "hidden_hits", "hidden_rate", "capitals", "caps_words", "exclaims", "questions", "punctuation", "digits", "stretched", "word_length", "longest_run"]

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACES = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
# Begins where a run of these characters begins and looks through it once, so that long runs take linear time.
_LEETED = re.compile(rb"(?<![a-z0-9@$!])(?=[a-z0-9@$!]*?[a-z][0-9@$!]+[a-z])[a-z0-9@$!]+")
_SPELLED = re.compile(rb"(?<![a-z])(?:[a-z][ .*_-]){3,}[a-z](?![a-z])")
_STRETCHED = re.compile(rb"([a-z])\1\1")
_CAPS = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
STARTS = (4, 5, 6, 7, 8, 10, 12)


def words_of(low: bytes) -> list[bytes]:
    return low.translate(_SPACES).split()


def terms_of(raw: bytes) -> set[tuple[int, bytes]]:
    """A text's distinct words (0, word) and beginnings of longer words (length, beginning)."""
    words = set(words_of(raw.lower()))
    return {(0, w) for w in words} | {(k, w[:k]) for k in STARTS for w in words if len(w) > k}


class Lexicon:
    def __init__(self, words: set[bytes], starts: set[bytes]):
        self.words, self.starts = frozenset(words), frozenset(starts)
        self.lengths = sorted({len(x) for x in starts})
        self.gate = frozenset(x[: STARTS[0]] for x in starts)

    def begins(self, word: bytes) -> bool:
        return word[: STARTS[0]] in self.gate and any(len(word) > k and word[:k] in self.starts for k in self.lengths)

    def features(self, raw: bytes) -> list[float]:
        low = raw.lower()
        words = words_of(low)
        n, size = max(1, len(words)), max(1, len(raw))
        known, gate = self.words, self.gate
        exact = [i for i, w in enumerate(words) if w in known]
        begun = [i for i, w in enumerate(words) if w[:4] in gate and self.begins(w)]
        you = [i for i, w in enumerate(words) if w in SECOND]
        marked = {j for i in you for j in range(i - 5, i + 6)}
        hidden = [w.translate(LEET) for w in _LEETED.findall(low)]
        hidden += [re.sub(rb"[^a-z]", b"", w) for w in _SPELLED.findall(low)]
        found = sum(1 for w in hidden if w in known or self.begins(w))
        count = lambda kept: len(raw) - len(raw.translate(None, kept))
        letters = count(_LETTERS)
        run = best = 0
        previous = None
        for w in words:
            run = run + 1 if w == previous else 1
            best, previous = max(best, run), w
        hits = set(exact) | set(begun)
        import math

        return [
            math.log1p(len(words)), float(len(exact)), len(exact) / n, float(len(begun)), len(begun) / n,
            len(hits & marked) / n, len(you) / n, float(found), len(hidden) / n,
            count(_UPPER) / max(1, letters), len(_CAPS.findall(raw)) / n,
            raw.count(b"!") / n, raw.count(b"?") / n, count(_PUNCTUATION) / size, count(_DIGITS) / size,
            len(_STRETCHED.findall(low)) / n, sum(map(len, words)) / n, best / n,
        ]


def mine_lexicon(docs: DataFrame, most: int = LEXICON) -> Lexicon:
    """Of docs (text, label), the terms that mark label 1 most surely. docs is the bounded sample."""

    def count(batches):
        import pyarrow as pa

        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for raw, label in zip(raw_texts(batch["text"]), batch["label"].to_pylist(), strict=True):
                found[label].update(terms_of(raw))
        for label in (0, 1):
            items = list(found[label].items())
            for at in range(0, len(items), 20_000):
                some = items[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([t[0] for t, _ in some], pa.int32()), pa.array([t[1] for t, _ in some], pa.binary()), pa.array([label] * len(some), pa.int32()), pa.array([c for _, c in some], pa.int64())], names=["kind", "term", "label", "n"])

    side = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0))
    total = {r["label"]: r["count"] for r in docs.groupBy("label").count().collect()}
    terms = docs.select("text", "label").mapInArrow(count, "kind int, term binary, label int, n long").groupBy("kind", "term").agg(side(1).alias("pos"), side(0).alias("neg")).where("pos >= 4")
    lift = F.log((F.col("pos") + 0.5) / (total.get(1, 0) + 1.0)) - F.log((F.col("neg") + 0.5) / (total.get(0, 0) + 1.0))
    terms = terms.withColumn("z", lift / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))).withColumn("lift", lift).where("z > 3 and lift > 1.5")
    best = [terms.where(c).orderBy(F.desc("z"), "term").limit(most).collect() for c in ("kind = 0", "kind > 0")]
    return Lexicon({bytes(r["term"]) for r in best[0]}, {bytes(r["term"]) for r in best[1]})


def featurise(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and the features of text (null: empty)."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = [lexicon.features(raw) for raw in raw_texts(batch["text"])]
            columns = list(zip(*found, strict=True)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *[pa.array(x, pa.float64()) for x in columns]], names=[*keep, *FEATURES])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(rows, ", ".join([*[f"{c} {kinds[c]}" for c in keep], *[f"{c} double" for c in FEATURES]]))


def toxicity(docs: DataFrame, labels: DataFrame, held_out, most_rows: int = MOST_ROWS, seed: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    labels (doc_id, toxic): where an id has several, the largest counts; nulls don't. held_out is a
    condition on doc_id; such rows teach nothing. At most about most_rows labelled rows, drawn by a hash
    of the id, are fitted on. A null text is empty and scored like others. Where labels of either kind
    are missing, all scores are the share of label 1 (0 without any labels). An empty table gives an empty
    result. Columns of docs other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where(~held_out)
    labels = scratch.write("labels", labels)
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    labels = labels.where(part < F.lit(int(1_000_000 * min(1.0, most_rows / max(1, n)))))
    marked = labels.select(F.col("doc_id").alias("_id"), "label", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(10)).alias("fold"))
    sample = scratch.write("sample", plain.join(F.broadcast(marked) if n <= BROADCAST_ROWS else marked, F.col("doc_id") == F.col("_id")).select("text", "label", "fold"))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        score = F.lit(float(max(counts, default=0)))
        return plain.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))

    lexicon = mine_lexicon(sample.where("fold < 4"))
    fitted = scratch.write("fitted", featurise(sample.where("fold >= 4"), lexicon, ["label", "fold"]))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    grow = vector.transform(fitted.where("fold < 8")).select("features", F.col("label").cast("double").alias("label"))
    if grow.select("label").distinct().count() < 2:
        grow = vector.transform(fitted).select("features", F.col("label").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.2, maxBins=48, minInstancesPerNode=5, seed=seed).fit(grow.coalesce(8))
    raw = lambda d, keep: trees.transform(vector.transform(d)).select(*keep, vector_to_array("rawPrediction")[1].alias("raw"))
    check = raw(fitted.where("fold >= 8"), [F.col("label").cast("double").alias("label")])
    if check.isEmpty():
        check = raw(fitted, [F.col("label").cast("double").alias("label")])
    calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(check)
    out = calibrated.transform(raw(featurise(plain, lexicon, ["doc_id"]), ["doc_id"]))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    held_out = crc32_of_id(F.col("doc_id")) % 4 == 2
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), held_out)
