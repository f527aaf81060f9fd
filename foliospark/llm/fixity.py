"""Merkle fixity audit of WARC records.

Pages become WARC records, laid end to end in shards. A record's leaf is the digest of its bytes; a node
is the digest of up to FANOUT children, each with its range of offsets from the node's start; shards are
subtrees of one tree, whose root speaks for everything. Two replicas are compared from their roots down,
level by level, and only below nodes that differ.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

FANOUT = 16
#: Ids that agree but for their last bits share a shard.
SHARD_BITS = 10
#: While at most this many nodes are open, the files of the next level are read by their children's ranges alone.
NARROW = 256


def warc_record(page_id, url, html):
    """The bytes of a WARC response record."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def manifest(pages: DataFrame, more: list[str] | None = None) -> DataFrame:
    """shard, seq, page_id, offset, length and digest of each record of pages (page_id, url, html), and columns more.

    A shard's records lie in the order of id, digest and address. Null ids lie in shard -1. Positions are added up
    in two steps, over the records of one id and one beginning of digests and over these groups, so that an id of
    very many records, or none, is spread.
    """
    more = more or []
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    shard = F.coalesce(F.shiftright(F.col("page_id").cast("long"), SHARD_BITS), F.lit(-1).cast("long"))
    r = pages.select(shard.alias("shard"), F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"), *more)
    r = r.withColumn("_begins", F.substring("digest", 1, 2))
    group = ["shard", "page_id", "_begins"]
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    by_shard, inside = Window.partitionBy("shard").orderBy("page_id", "_begins"), Window.partitionBy(*group).orderBy("digest", "url")
    sums = r.groupBy(*group).agg(F.count("*").alias("_n"), F.sum("length").alias("_bytes"))
    sums = sums.select(F.col("shard").alias("_s"), F.col("page_id").alias("_p"), F.col("_begins").alias("_b"), before(by_shard, "_n").alias("_seq"), before(by_shard, "_bytes").alias("_offset"))
    r = r.withColumn("_k", (F.row_number().over(inside) - 1).cast("long")).withColumn("_at", before(inside, "length"))
    both = r.join(sums, (F.col("shard") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_begins") == F.col("_b")))
    return both.select("shard", (F.col("_seq") + F.col("_k")).alias("seq"), "page_id", (F.col("_offset") + F.col("_at")).alias("offset"), "length", "digest", *more)


def leaves(records: DataFrame, depth: int, first_shard: int) -> DataFrame:
    """Level 0: node numbers such that a shard is one node of level depth."""
    node = (F.col("shard") - first_shard) * FANOUT**depth + F.col("seq")
    return records.select(node.alias("node"), "length", "digest")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level. A node's digest covers its children's numbers, offset ranges and digests."""
    up = nodes.groupBy(F.expr(f"node div {FANOUT}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "length", "digest"))).alias("c"))  # at most FANOUT
    ranged = F.aggregate(
        "c",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")),
        lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.concat(a["text"], F.concat_ws(":", (x["node"] % FANOUT).cast("string"), a["at"].cast("string"), (a["at"] + x["length"]).cast("string"), x["digest"]), F.lit(";")).alias("text")),
    )
    return up.select(F.col("parent").alias("node"), ranged.alias("r")).select("node", F.col("r.at").alias("length"), F.sha2(F.col("r.text").cast("binary"), 256).alias("digest"))


def tree(level: DataFrame, height: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels, leaves first, root last. Files hold ranges of nodes in order, so that few of them hold a node's children."""
    out = []
    for k in range(height + 1):
        level = parents(out[-1]) if k else level
        out.append(scratch.write(f"{name}{k}", level.repartitionByRange("node").sortWithinPartitions("node")))
    return out


def _below(level: DataFrame, above: DataFrame, n: int) -> DataFrame:
    """The children, in level, of the n nodes above."""
    if n <= NARROW:
        ranges = [F.col("node").between(r["node"] * FANOUT, r["node"] * FANOUT + FANOUT - 1) for r in above.collect()]
        return level.where(reduce(lambda a, b: a | b, ranges))
    return level.join(above.withColumnRenamed("node", "parent"), F.expr(f"node div {FANOUT}") == F.col("parent"), "left_semi")


def differing_leaves(one: list[DataFrame], other: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Numbers of leaves that differ, found from the roots down; only children of differing nodes are read and compared."""
    open_nodes = n = None
    for k in range(len(one) - 1, -1, -1):
        a, b = one[k], other[k]
        if open_nodes is not None:
            a, b = _below(a, open_nodes, n), _below(b, open_nodes, n)
        both = a.select("node", F.struct("length", "digest").alias("x")).join(b.select("node", F.struct("length", "digest").alias("y")), "node", "full_outer")
        open_nodes = scratch.write(f"open{k}", both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node"))
        n = open_nodes.count()
        if n == 0:
            break
    return open_nodes


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """The records that a replica has lost, holds with other bytes, or holds beyond the manifest.

    records and replica are manifests, each of what is held in its place. Returns shard, seq, page_id, offset, length,
    digest, and replica_digest: null for a lost record; digest is null for a surplus one, whose other columns are the
    replica's. Nothing where the roots agree, and for two empty manifests. shard and seq name a record once.
    """
    scratch = Scratch(records.sparkSession)
    columns = ["shard", "seq", "page_id", "offset", "length", "digest"]
    records, replica = (scratch.write(name, x.select(*columns)) for name, x in (("records", records), ("replica", replica)))
    most, first, last = records.union(replica).agg(F.max("seq"), F.min("shard"), F.max("shard")).first()
    if most is None:
        return records.withColumn("replica_digest", F.lit(None).cast("string"))
    depth = height = 0
    while FANOUT**depth <= most:
        depth += 1
    while FANOUT**height <= (last - first + 1) * FANOUT**depth - 1:
        height += 1
    one, other = (tree(leaves(x, depth, first), height, scratch, name) for name, x in (("one", records), ("other", replica)))
    width = FANOUT**depth
    bad = differing_leaves(one, other, scratch).select((F.expr(f"node div {width}") + first).alias("shard"), (F.col("node") % width).alias("seq"))
    here, there = (x.join(bad, ["shard", "seq"], "left_semi") for x in (records, replica))
    both = here.withColumn("_here", F.lit(True)).join(there.select("shard", "seq", *[F.col(c).alias(f"_{c}") for c in columns[2:]]), ["shard", "seq"], "full_outer")
    mine = lambda c: F.when(F.col("_here"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return both.select("shard", "seq", mine("page_id"), mine("offset"), mine("length"), "digest", F.col("_digest").alias("replica_digest"))


def op1_fixity_audit(spark, sf_dir: str) -> DataFrame:
    """A replica of pages in which a byte of some records has changed and others are lost, by a hash of the id.

    Rows that repeat an id or lack one are records like others; those without an id are neither changed nor lost.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    rotten = F.when(fate == "0d", F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    copy = warc_record(F.col("page_id"), F.col("url"), rotten)
    held = manifest(pages.withColumn("copy_digest", F.when(fate != "0e", F.sha2(copy, 256))).withColumn("copy_length", F.octet_length(copy).cast("long")), ["copy_digest", "copy_length"])
    replica = held.where("copy_digest is not null").select("shard", "seq", "page_id", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))
    return audit(held, replica)


OP1_SQL = r"""
WITH r AS (
  SELECT page_id, url, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS tail, substr(md5(page_id::VARCHAR), 1, 2) AS fate, page_id // 1024 AS shard FROM pages
), m AS (
  SELECT shard, (row_number() OVER (PARTITION BY shard ORDER BY page_id) - 1)::BIGINT AS seq, page_id,
    coalesce(sum(strlen(head || html || tail)) OVER (PARTITION BY shard ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    strlen(head || html || tail)::BIGINT AS length, sha256(head || html || tail) AS digest,
    CASE WHEN fate = '0d' THEN sha256(head || '#' || substr(html, 2) || tail) WHEN fate <> '0e' THEN sha256(head || html || tail) END AS replica_digest FROM r
)
SELECT shard::BIGINT AS shard, seq, page_id, "offset", length, digest, replica_digest FROM m WHERE digest IS DISTINCT FROM replica_digest
"""
