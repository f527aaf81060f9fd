"""From documents to packed sequences. Each stage's result is written and read again as the next one's docs."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch
from foliospark.llm.exact_dedup import exact_dedup
from foliospark.llm.mixing import mix
from foliospark.llm.near_dedup import near_dedup
from foliospark.llm.packing import pack
from foliospark.llm.quality import quality_labels, resample

#: Up to this many ids are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 1 << 20


#: A column of row numbers, where ids don't tell rows apart.
ROW = "_pipeline_row"


def _without(docs: DataFrame, decide: Callable) -> DataFrame:
    """docs without the rows that decide(docs, row) rejects; of rows of one group_id that it keeps, one.

    Rows are told apart by doc_id, or, where ids repeat, by numbers that they are given and written with.
    """
    scratch = Scratch(docs.sparkSession)
    row = None
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        row = ROW
        docs = scratch.write("rows", docs.withColumn(row, F.monotonically_increasing_id()))
    by = row or "doc_id"
    decided = decide(docs, row)
    decided = scratch.write("decided", decided.select(by, "kept", *[c for c in decided.columns if c == "group_id"]))
    gone = decided.where("not kept").select(by)
    if row and "group_id" in decided.columns:
        kept = decided.where("kept and group_id is not null")
        gone = scratch.write("gone", gone.union(kept.select(by).join(kept.groupBy("group_id").agg(F.min(by).alias(by)), by, "left_anti")))
    gone = gone.withColumnRenamed(by, "_gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(by).eqNullSafe(F.col("_gone")), "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what importance resampling rejects: all rows but the share of good texts among labelled ones and a bit
    more. Empty and null texts have importance 1; rows that repeat an id and a text fare alike."""
    return resample(docs, quality_labels(spark, sf_dir))[1](docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and one row only where ids repeat. Null texts are
    empty; a null id is the smallest."""
    return _without(docs, lambda d, row: exact_dedup(d, row=row))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, and one row only where ids
    repeat. Texts without words are in no group and stay; a null id is the smallest."""
    return _without(docs, lambda d, row: near_dedup(d, row=row))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Rows that repeat an id fare alike;
    null sources are one source; texts without words have size 0 and are taken with the rest."""
    taken = mix(docs, prefix="_mix_").where("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, with the ids. A null or empty text is its end id alone; rows that repeat an
    id are packed each on their own; columns other than doc_id and text end here."""
    return pack(docs, with_ids=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: The sketches, likelihoods and tokenizer of the stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(f"stage{k}", docs)
    return docs
