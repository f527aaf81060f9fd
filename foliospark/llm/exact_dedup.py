"""Exact dedup by composable polynomial fingerprints.

A text is lower-cased (A-Z only) and cut into chunks. Each chunk's polynomial hash, shifted by the
length of what follows it, is a term of the text's fingerprint, and the terms just add up: they may
be made anywhere and in any order. Huge texts send their chunks to many tasks; others add their terms
where they are. Texts of equal fingerprint and length are then compared chunk by chunk, each chunk
number an aggregate of its own, which combines before the shuffle however many copies there are.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, raw_texts, table

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
CHUNK = 1 << 16
#: From this many bytes on, a text's chunks are hashed by many tasks.
HUGE = 32 << 20
#: Up to this many fingerprints (24 bytes each) are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 1 << 20


def _powers() -> list[np.ndarray]:
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        powers = np.ones(CHUNK, dtype=np.uint64)
        for k in range(16):  # doubles what is known
            half = 1 << k
            powers[half : 2 * half] = powers[:half] * np.uint64(pow(b, half, p)) % np.uint64(p)
        out.append(powers[::-1].copy())
    return out


def terms(raw: bytes, after: int, powers: list[np.ndarray]) -> list[int]:
    """The terms of raw, which after bytes follow, in the fingerprint of the whole, for each prime."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    whole = len(b) // CHUNK * CHUNK
    out = []
    for p, base, powers_here in zip(PRIMES, BASES, powers, strict=True):
        value, shift = 0, pow(base, CHUNK, p)
        if whole:
            for x in (b[:whole].reshape(-1, CHUNK) * powers_here).sum(axis=1) % np.uint64(p):
                value = (value * shift + int(x)) % p
        tail = b[whole:]
        if len(tail):
            value = (value * pow(base, len(tail), p) + int((tail * powers_here[CHUNK - len(tail) :]).sum() % np.uint64(p))) % p
        out.append(value * pow(base, after, p) % p)
    return out


PART = "row_id long, doc_id long, n_bytes long, text_sha256 string, fp1 long, fp2 long, after long, chunk binary"


def fingerprint_parts(docs: DataFrame, huge: int = HUGE, row: str | None = None) -> DataFrame:
    """Per document one row with its fingerprint; per huge document also its chunks, not yet hashed."""

    def parts(batches):
        import pyarrow as pa

        powers = _powers()
        schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("after", pa.int64()), ("chunk", pa.binary())])
        for batch in batches:
            rows = []
            for row_id, doc_id, raw in zip(batch["row_id"].to_pylist(), batch["doc_id"].to_pylist(), raw_texts(batch["text"]), strict=True):
                low = raw.lower()
                sha, n = hashlib.sha256(low).hexdigest(), len(low)
                if n < huge:
                    rows.append((row_id, doc_id, n, sha, *terms(low, 0, powers), None, None))
                    continue
                rows.append((row_id, doc_id, n, sha, 0, 0, None, None))
                step = CHUNK * 64
                for at in range(0, n, step):
                    rows.append((row_id, None, n, None, None, None, max(0, n - at - step), low[at : at + step]))
                    if len(rows) >= 16:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(parts, PART)


def hash_chunks(parts: DataFrame) -> DataFrame:
    """The terms of huge documents' chunks, spread over tasks and added up by document."""

    def hashed(batches):
        import pyarrow as pa

        powers = _powers()
        for batch in batches:
            found = [terms(c, a, powers) for c, a in zip(batch["chunk"].to_pylist(), batch["after"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row_id"], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["row_id", "add1", "add2"])

    chunks = parts.where("chunk is not null").select("row_id", "after", "chunk").repartition("row_id", "after")
    return chunks.mapInArrow(hashed, "row_id long, add1 long, add2 long").groupBy("row_id").agg(*[(F.sum(f"add{k}") % PRIMES[k - 1]).alias(f"add{k}") for k in (1, 2)])


KEY = ["fp1", "fp2", "n_bytes"]


def _texts(docs: DataFrame) -> DataFrame:
    """Fingerprints, hashed in one go, with the normalised texts."""

    def again(batches):
        import pyarrow as pa

        powers = _powers()
        for batch in batches:
            low = [x.lower() for x in raw_texts(batch["text"])]
            found = [terms(x, 0, powers) for x in low]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([len(x) for x in low], pa.int64()), pa.array(low, pa.binary())], names=[*KEY, "low"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(again, "fp1 long, fp2 long, n_bytes long, low binary")


def compare_chunkwise(docs: DataFrame, repeated: DataFrame, small: bool) -> DataFrame:
    """Of the fingerprints in repeated, those whose texts aren't all equal (as good as none)."""
    texts = _texts(docs).join(F.broadcast(repeated) if small else repeated, KEY, "left_semi")
    step = 4 * CHUNK
    chunks = texts.select(*KEY, "low", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_bytes - 1) div {step} as int)"))).alias("k")).select(*KEY, "k", F.expr(f"substring(low, k * {step} + 1, {step})").alias("chunk"))
    return chunks.groupBy(*KEY, "k").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select(*KEY).distinct()


def exact_dedup(docs: DataFrame, huge: int = HUGE, row: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest doc_id stays (a null id is the smallest); of rows that repeat an id and a
    text exactly one is kept. Empty tables give an empty result; other columns are not read. row names
    a column of docs, a long that differs on every row, which the result then has as well.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = scratch.write("parts", fingerprint_parts(docs, huge, row))
    rows = parts.where("chunk is null").drop("after", "chunk")
    if not parts.where("chunk is not null").isEmpty():
        whole = rows.join(hash_chunks(parts), "row_id", "left")
        rows = scratch.write("rows", whole.select("row_id", "doc_id", "n_bytes", "text_sha256", *[F.expr(f"(fp{k} + coalesce(add{k}, 0)) % {PRIMES[k - 1]}").alias(f"fp{k}") for k in (1, 2)]))
    repeated = scratch.write("repeated", rows.groupBy(*KEY).count().where("count > 1").select(*KEY))
    unlike = scratch.write("unlike", compare_chunkwise(docs, repeated.where("n_bytes > 0"), repeated.count() <= BROADCAST_ROWS))
    # Where fingerprints collide, the digest of the whole text tells texts apart.
    clashes = not unlike.isEmpty()
    by_text = ["text_sha256"] if clashes else []
    classes = rows.groupBy(*KEY, *by_text).agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    classes = scratch.write("classes", classes.select(*KEY, *by_text, F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_id").alias("keep_row"), "group_size"))
    joined = rows.join(classes, [*KEY, *by_text], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row_id"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_bytes",
        *([] if row is None else [F.col("row_id").alias(row)]),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), s AS (SELECT doc_id, strlen(low)::BIGINT AS n_bytes, sha256(low) AS text_sha256 FROM t),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM s GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s.text_sha256, n_bytes FROM s JOIN g ON s.text_sha256 = g.text_sha256
"""
