"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 64-bit hash. Words are summed by source and top bits of the hash; the bucket in
which a source's budget ends is found from these sums and refined alone by the next bits, and so on.
What remains is one threshold per source: a filter, and no sort of documents.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

WEIGHTS = (5.0, 2.0, 1.0)
#: What the mix holds, in sizes of all documents, and at most of a source, in its sizes.
SHARE, MOST = 1.5, 2.0
#: Bits a level of the histogram has, and levels.
BITS, LEVELS = 12, 4
_HASH_BITS = 48


def hash48(seed: int = 0):
    """48 bits of md5 over id and seed, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words for each source of (source, source_size): budgets by weight, capped, the excess dealt anew.

    The sources that end at their cap are those of the least cap for their weight; so one pass in
    that order finds the level of the rest. It works on one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = reduce(lambda a, k: a.when(F.col("rank") % len(weights) == k, F.lit(float(weights[k]))), range(1, len(weights)), F.when(F.col("rank") % len(weights) == 0, F.lit(float(weights[0]))))
    t = by_source.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order, everything = Window.orderBy(F.col("cap") / F.col("weight"), "rank"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everything))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return t.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNotNull(), F.least(F.col("final") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, prefix: str = "") -> DataFrame:
    """The columns of docs (doc_id, text, source) with size, source_size, target, taken and copies.

    A document is taken whole, floor(target / source_size) times, and once more below its source's
    hash threshold: the largest at which the source's words stay within its target, to a single
    document. Documents of one hash stand or fall together. Null texts have size 0 and are taken with
    the rest; null sources form one source, the last. Columns of docs that clash with the added ones,
    whose names prefix begins, are replaced. Reruns agree. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    added = ["size", "source_size", "target", "copies", "taken"]
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {prefix + x for x in added}])
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The passes below work on three narrow columns; texts are counted a second time only for the rows that come out.
    narrow = scratch.write("narrow", docs.select("source", size.alias("size"), hash48(seed).alias("h")))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = targets(totals, weights, share, most).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    # left: words still to take by an extra copy; prefix: the boundary bucket so far; lower: its start.
    state = scratch.write("state", state.select("*", (F.col("target") - F.col("full") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")))
    for k in range(LEVELS):
        shift = _HASH_BITS - BITS * (k + 1)
        inside = narrow.where("size > 0")
        if k:
            boundary = state.select(F.col("source").alias("s"), "prefix")
            inside = inside.join(boundary, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        inside = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        # At most 2^BITS buckets a source are left, however many documents there are.
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = inside.withColumn("run", F.sum("words").over(run)).join(state.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        fits = F.col("run") <= F.col("left")
        step = summed.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("run"))), F.lit(0)).alias("used"), F.min(F.when(~fits, F.col("bucket"))).alias("bucket"))
        step = step.withColumnRenamed("source", "s")
        joined = state.join(step, F.col("source").eqNullSafe(F.col("s")), "left")
        # Without a bucket that overflows all fits: the threshold is then the end of the prefix.
        state = scratch.write(f"state{k}", joined.select("source", "source_size", "target", "full", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), F.coalesce("bucket", (F.col("prefix") + 1) * (1 << BITS)).alias("prefix")))
    found = state.select(F.col("source").alias("_mix_s"), *[F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "full", "prefix")])
    out = d.join(found, F.col("source").eqNullSafe(F.col("_mix_s")), "left")
    copies = F.col("_mix_full") + (hash48(seed) < F.col("_mix_prefix")).cast("long")
    values = [size, F.col("_mix_source_size").cast("long"), F.col("_mix_target"), copies, copies * size]
    return out.select(*[F.col(f"`{c}`") for c in d.columns], *[v.alias(prefix + c) for v, c in zip(values, added, strict=True)])


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT arg_min(level, (cap / weight, rank)) AS final FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(final * weight, cap) AS target FROM w, f),
p AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN run <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
