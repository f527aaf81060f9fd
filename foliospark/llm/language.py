"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, what is no letter becomes one space, and n-grams of one to three characters are hashed into a
fixed number of features. Document frequencies come from all rows that may teach. Weights are fitted on a bounded
sample with follow-the-regularised-leader: each coordinate has its own rate, an L1 penalty that keeps weights sparse
and an L2 penalty. Shards of the sample are passed over at the same time, each from the mean of all; after a few rounds
a temperature, chosen on rows of the sample that taught no weights, calibrates the scores.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc32_of_id, table

#: Rows that teach weights and temperature: at most about so many of each language, drawn at random.
MOST_ROWS = 4_000
#: Hashed features, and the lengths of n-grams.
FEATURES, ORDERS = 1 << 16, (1, 2, 3)
#: Rounds over the sample, and shards that are passed over at the same time.
ROUNDS, SHARDS = 4, 8
#: The rates of follow-the-regularised-leader, and its penalties.
ALPHA, BETA, L1, L2 = 2.0, 0.5, 0.02, 0.02
#: Mean TF-IDF values are about 1 / SCALE.
SCALE = 50.0
#: Temperatures that are tried: 1/20 to 20.
TEMPERATURES = [10 ** (k / 60 - 1.3) for k in range(157)]
UNKNOWN = "und"


class Grams:
    """Features of the n-grams of a text, one for each occurrence."""

    def __init__(self, features: int = FEATURES):
        import numpy as np

        self.features = features
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str):
        """An empty array for a text without letters."""
        import numpy as np

        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.letter[codes]
        if not letter.any():
            return np.empty(0, np.int64)
        # One space for each run of others, and one at both ends.
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = np.where(letter, codes, 32)[keep].astype(np.uint64)
        c = np.concatenate([c[:0], [32], c, [32][: int(letter[-1])]]).astype(np.uint64)
        out = []
        for n in ORDERS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h + c[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            if n == 1:
                h = h[c != 32]
            out.append(h)
        mixed = np.concatenate(out) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) % np.uint64(self.features)).astype(np.int64)


def statistics(docs: DataFrame, features: int = FEATURES) -> DataFrame:
    """feature, lang, n of docs (lang, text): rows that hold a feature, and rows of each language (feature is null)."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        grams, df, langs = Grams(features), np.zeros(features, np.int64), {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = grams(text or "")
                if len(found):
                    df[np.flatnonzero(np.bincount(found, minlength=features)) if len(found) > 2048 else np.unique(found)] += 1
                    langs[lang] = langs.get(lang, 0) + 1
        held = np.flatnonzero(df)
        none = len(langs)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), *[None] * none], pa.int32()), pa.array([*[None] * len(held), *langs], pa.string()), pa.array([*df[held].tolist(), *langs.values()], pa.int64())], names=["feature", "lang", "n"])

    return docs.select("lang", "text").mapInArrow(rows, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))


def weights_of(z, n):
    """The weights that z and n stand for."""
    import numpy as np

    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(x):
    import numpy as np

    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def pass_over(state, rows) -> int:
    """One pass of follow-the-regularised-leader. state: z and n, features (the last one is 1 in every row) by classes;
    rows: (features, values, class). Returns how many rows there were."""
    z, n = state
    seen = 0
    for at, x, y in rows:
        w = weights_of(z[at], n[at])
        g = softmax(x @ w)
        g[y] -= 1.0
        g = x[:, None] * g
        root = (n[at] + g * g) ** 0.5
        z[at] += g - (root - n[at] ** 0.5) / ALPHA * w
        n[at] += g * g
        seen += 1
    return seen


def fit(sample: DataFrame, idf, classes: int, rounds: int = ROUNDS, shards: int = SHARDS):
    """Weights (features and a constant by classes) from sample (label, text, order). Shards are put in order, so that
    reruns agree."""
    import numpy as np

    size = len(idf)
    state = np.zeros((2, size + 1, classes))
    dealt = sample.repartition(shards, "order").sortWithinPartitions("order", "label", "text")
    for _ in range(rounds):
        start = state

        def train(batches, start=start):
            import numpy as np
            import pyarrow as pa

            grams, mine = Grams(size), start.copy()

            def rows():
                for batch in batches:
                    for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                        found = grams(text)
                        at, times = np.unique(found, return_counts=True)
                        yield np.append(at, size), np.append(SCALE * times / max(1, len(found)) * idf[at], 1.0), label

            seen = pass_over(mine, rows())
            change = (mine - start).reshape(2, -1) * seen
            cells = np.flatnonzero(change.any(axis=0))
            columns = [pa.array(np.append(cells, -1), pa.int32()), pa.array(np.append(change[0, cells], seen)), pa.array(np.append(change[1, cells], 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "z", "n"])

        # As many rows as features times classes at most.
        moved = dealt.select("label", "text").mapInArrow(train, "cell int, z double, n double").groupBy("cell").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        cell, z, n = (moved[c].to_numpy() for c in ("cell", "z", "n"))
        total = max(1.0, float(z[cell < 0].sum()))
        step = np.zeros((2, state[0].size))
        step[0, cell[cell >= 0]], step[1, cell[cell >= 0]] = z[cell >= 0] / total, n[cell >= 0] / total
        state = state + step.reshape(state.shape)
    return weights_of(*state)


def scorer(weights, idf):
    """A function of a text to the logits of the classes, or None for a text without letters."""
    import numpy as np

    grams, table_, bias = Grams(len(idf)), np.ascontiguousarray(SCALE * weights[:-1] * idf[:, None]), weights[-1]

    def logits(text: str):
        found = grams(text)
        if not len(found):
            return None
        if len(found) > 1 << 18:
            return np.bincount(found, minlength=len(idf)) @ table_ / len(found) + bias
        return table_[found].sum(axis=0) / len(found) + bias

    return logits


def temperature(check: DataFrame, weights, idf) -> float:
    """Of TEMPERATURES the one by which the rows of check (label, text) are likeliest."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        logits, t, total = scorer(weights, idf), np.array(TEMPERATURES), np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                total -= np.log(np.maximum(1e-12, softmax(logits(text)[None, :] / t[:, None])[:, label]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int32()), pa.array(total)], names=["k", "loss"])

    loss = check.select("label", "text").mapInArrow(rows, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    return TEMPERATURES[min(loss, key=lambda r: (round(r["loss"], 9), abs(r["k"] - 78)))["k"]] if any(r["loss"] for r in loss) else 1.0


def train(docs: DataFrame, most_rows: int = MOST_ROWS, features: int = FEATURES, seed: int = 5):
    """(languages, weights, idf, temperature) from docs (doc_id, text, lang), all of which may teach; rows without a
    language or letters don't. The weights are a table of features times languages."""
    import numpy as np

    scratch = Scratch(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = scratch.write("statistics", statistics(docs, features)).toArrow()  # a row for each feature and language
    feature, n = found["feature"].to_numpy(zero_copy_only=False), found["n"].to_numpy()
    rows = {lang: k for lang, k in zip(found["lang"].to_pylist(), n.tolist(), strict=True) if lang is not None}
    langs, total = sorted(rows), sum(rows.values())
    df = np.zeros(features)
    held = ~np.isnan(feature.astype(float))
    df[feature[held].astype(int)] = n[held]
    idf = np.log((1 + total) / (1 + df)) + 1
    if len(langs) < 2:
        return langs, np.zeros((features + 1, len(langs))), idf, 1.0
    share, label = F.lit(0.0), F.lit(None).cast("int")
    for k, lang in enumerate(langs):
        share, label = F.when(F.col("lang") == lang, min(1.0, most_rows / rows[lang])).otherwise(share), F.when(F.col("lang") == lang, k).otherwise(label)
    drawn = docs.where(F.rand(seed) < share).withColumn("label", label).where(F.col("text").rlike(r"\p{L}"))
    drawn = scratch.write("sample", drawn.select("label", "text", F.xxhash64("doc_id", F.lit(seed)).alias("order")))
    teach = F.pmod(F.col("order"), F.lit(5)) > 0
    weights = fit(drawn.where(teach), idf, len(langs))
    return langs, weights, idf, temperature(drawn.where(~teach), weights, idf)


def identify(docs: DataFrame, model) -> DataFrame:
    """The columns of docs (with text) but text, and lang_pred and score, by a model of train(). Where a text is null or has no letter,
    or nothing was learned, lang_pred is "und" and score 0. An empty table gives an empty result."""
    langs, weights, idf, heat = model
    docs = docs.withColumn("text", F.col("text").cast("string"))

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        logits = scorer(weights, idf)
        for batch in batches:
            pred, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for i, text in enumerate(batch["text"].to_pylist() if langs else []):
                found = logits(text) if text else None
                if found is not None:
                    p = softmax(found / heat)
                    pred[i], score[i] = langs[int(np.argmax(p))], float(p.max())
            kept = [k for k, name in enumerate(batch.schema.names) if name not in ("text", "lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*[batch.schema.names[k] for k in kept], "lang_pred", "score"])

    kept = [f"`{name}` {kind}" for name, kind in docs.dtypes if name not in ("text", "lang_pred", "score")]
    return docs.mapInArrow(rows, ", ".join([*kept, "lang_pred string", "score double"]))


def op11_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    docs = docs.withColumn("held_out", crc32_of_id(F.col("doc_id")) % 4 == 2)
    return identify(docs.select("doc_id", "held_out", "text"), train(docs.where("not held_out")))
