"""Near-dedup by SetSketch registers.

A document's set of five-word shingles is sketched by M registers. Register i keeps the least point
that any shingle throws into it, where each shingle throws a Poisson process of points, and stores it
on a scale whose steps grow by the factor BASE, cut off at both ends. Sketches merge by their larger
registers and agree in a register about as often as the sets overlap. Bands of registers give
candidates; the registers' joint likelihood gives the overlap's estimate, which drops those far from
the threshold; what is left is confirmed on the full sets.

Equal sets are one class from the start. Within a band's bucket classes are first held against one hub,
the member that shares most buckets; this joins large groups by a number of pairs that grows with the
group, not with its square. Of classes that share a bucket and are then in different components, the
members outside the bucket's commonest component are held against the others. Where these are many, they
meet one more hub of the commonest component in each bucket; pairs of what is left, as with a passage that
very many documents share, come from an exact filter: sets that link share one of their rarest shingles.

Bands miss a pair at exactly the threshold with a probability of about 5e-6; shingles are told apart by
64-bit hashes.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, raw_texts, shingle_hashes, table, word_hasher

SHINGLE = 5
#: A link needs 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 75
BANDS, ROWS = 32, 4
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Candidates are dropped where their estimate is over six standard errors under the threshold.
SLACK = 0.25
#: Buckets where members outside the commonest component would meet others in more pairs than this are paired by rare shingles.
DENSE = 1024
#: In the order of shingles those of more sets than this come last, by their number of sets.
COMMON = 16
#: At most this many of them, 16 bytes each, are sent to all tasks; where there might be more, COMMON rises.
COMMON_ROWS = 1 << 20
#: Rows of a bucket or a shingle that meet others in one group.
PART = 1024
#: Up to this many ids or groups are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 1 << 20


def registers(h: np.ndarray) -> np.ndarray:
    """The M registers of a set of hashes, as 16-bit numbers; all 0 for the empty set."""
    if len(h) == 0:
        return np.zeros(M, dtype="<u2")
    most = (np.log(M) + 7.0) / len(h)
    while True:
        best = np.full(M, np.inf)
        alive, x, j = h, np.zeros(len(h)), 0
        while len(alive):
            # Each row holds the next points of one element, in rising order.
            block = 1 if len(alive) > 4096 else min(64, max(2, 4096 // len(alive)))
            step = np.arange(j + 1, j + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            r = alive[:, None] ^ step[None, :]
            r = (r ^ (r >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            r = (r ^ (r >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            r ^= r >> np.uint64(31)
            gaps = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / M
            at = x[:, None] + np.cumsum(gaps, axis=1)
            near = at < most
            np.minimum.at(best, (r[near] & np.uint64(M - 1)).astype(np.intp), at[near])
            go = near[:, -1]
            alive, x, j = alive[go], at[go, -1], j + block
        if np.isfinite(best).all():
            return np.clip(np.floor(1.0 - np.log(best / RATE) / np.log(BASE)), 0, TOP).astype("<u2")
        most *= 2


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities that make the registers' orders likeliest, for rows of registers and set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    tiny = 1e-12

    def p(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1.0 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(40):
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def _set_id(h: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    import hashlib

    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, row: str | None = None) -> DataFrame:
    """k (the id; the least long for null), n_shingles, set_id and regs (both null for empty sets), and the column row."""
    more = [] if row is None else [row]

    def rows(batches):
        import pyarrow as pa

        hasher = word_hasher()
        for batch in batches:
            n, ids, regs = [], [], []
            for raw in raw_texts(batch["text"]):
                h = shingle_hashes(hasher(raw), SHINGLE)
                n.append(len(h))
                ids.append(_set_id(h) if len(h) else None)
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary()), *[batch[c] for c in more]], names=["k", "n_shingles", "set_id", "regs", *more])

    return _keyed(docs, more).mapInArrow(rows, ", ".join(["k long, n_shingles long, set_id binary, regs binary", *[f"`{c}` long" for c in more]]))


def _keyed(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    return docs.select(*(more or []), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.col("text").cast("string").alias("text"))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose estimate does not rule a link out."""
    least = percent / 100 - SLACK

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                cut = [np.frombuffer(b"".join(batch[c].to_pylist()), dtype="<u2").reshape(-1, M) for c in ("regs_a", "regs_b")]
                sizes = [batch[c].to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(estimate(*cut, *sizes) >= least))

    side = lambda x: classes.select(F.col("set_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.mapInArrow(keep, "a binary, b binary")


class Sets:
    """Full sets of classes, made from the texts of one document each, once for each class that is asked for."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, repeats: bool):
        self.docs, self.classes, self.scratch, self.repeats = docs, classes, scratch, repeats
        self.made: DataFrame | None = None

    def of(self, pairs: DataFrame) -> DataFrame:
        """set_id and shingles of at least the classes in pairs (a, b)."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        if self.made is not None:
            wanted = wanted.join(self.made.select("set_id"), "set_id", "left_anti")
        wanted = self.scratch.write("wanted", wanted.join(self.classes, "set_id").select("k").distinct(), 2 * pairs.count())
        n = wanted.count()
        if n:
            new = _keyed(self.docs).join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "k", "left_semi").mapInArrow(_full_sets, "set_id binary, shingles binary")
            if self.repeats:
                new = new.dropDuplicates(["set_id"])
                new = new if self.made is None else new.join(self.made.select("set_id"), "set_id", "left_anti")
            new = self.scratch.write("full", new)
            self.made = new if self.made is None else self.made.union(new)
        return self.made


def _full_sets(batches):
    import pyarrow as pa

    hasher = word_hasher()
    for batch in batches:
        found = [shingle_hashes(hasher(raw), SHINGLE) for raw in raw_texts(batch["text"])]
        yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], names=["set_id", "shingles"])


def confirmed(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that link, on their full sets."""

    def link(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = sets.of(pairs)
    if full is None:
        return pairs
    both = pairs.join(full.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.mapInArrow(link, "a binary, b binary")


def majorities(rows: DataFrame, by: str) -> DataFrame:
    """by, major, meetings, parts of rows (by, set_id, label): of each group with several labels the commonest, the
    rows of others times all, and the parts into which all are dealt."""
    n = rows.groupBy(by, "label").agg(F.count("*").alias("n"))
    g = n.groupBy(by).agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("total"), F.count("*").alias("labels"))
    return g.where("labels > 1").select(by, F.col("m.label").alias("major"), ((F.col("total") - F.col("m.n")) * F.col("total")).alias("meetings"), F.expr(f"cast((total - 1) div {PART} + 1 as int)").alias("parts"))


def _small(df: DataFrame) -> DataFrame:
    """df, for a join: broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def crossing(rows: DataFrame, groups: DataFrame, by: str, more: list[str] | None = None, fits=None) -> DataFrame:
    """Pairs (a, b) of set_ids with different labels in one of groups (by, major, parts), a written table: each has
    an end outside the commonest label, so that only such rows are held against their group's, part by part."""
    cols = ["set_id", "label", *(more or [])]
    inside = rows.join(_small(groups.select(by, "major", "parts")), by)
    few = inside.where("label <> major").select(by, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"x_{c}") for c in cols])
    every = inside.select(by, F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int").alias("part"), "major", *[F.col(c).alias(f"y_{c}") for c in cols])
    # Of two rows outside the commonest label one order is enough.
    where = (F.col("x_label") != F.col("y_label")) & ((F.col("y_label") == F.col("major")) | (F.col("x_set_id") < F.col("y_set_id")))
    found = few.join(every, [by, "part"]).where(where if fits is None else where & fits)
    return found.select(F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b")).distinct()


def second_hubs(labelled: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b): in each of groups (key, major), a written table, the rows outside the commonest label with one
    row of it, which differs from bucket to bucket."""
    inside = labelled.join(_small(groups.select("key", "major")), "key")
    hubs = inside.where("label = major").groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "set_id").alias("h"), "set_id")).alias("h")).select("key", F.col("h.set_id").alias("hub"))
    return inside.where("label <> major").join(hubs, "key").select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct()


def common_shingles(full: DataFrame, bar: int) -> DataFrame:
    """shingle and n, its number of sets, of the shingles that more than bar of full (shingles) hold."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            h, n = np.unique(np.frombuffer(b"".join(batch["shingles"].to_pylist()), dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return full.select("shingles").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > bar)


def rare_pairs(dense: DataFrame, sets: Sets, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of dense (set_id, label, n_shingles) with different labels that may link, exactly.

    Any order of all shingles will do: two sets that link share a shingle among the first n - ceil(percent * n) + 1
    of either, and the places of the first that they share leave room for the overlap that a link needs. Here
    common shingles come last, by their number of sets, so that passages that very many sets share pair none of them.
    """
    full = sets.of(dense.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")))
    full = scratch.write("dense_full", dense.join(full, "set_id"))
    bar = max(COMMON, (full.agg(F.sum("n_shingles")).first()[0] or 0) // COMMON_ROWS)
    found = common_shingles(full, bar).orderBy("shingle").toArrow()  # at most COMMON_ROWS rows
    shared = full.sparkSession.sparkContext.broadcast((found["shingle"].to_numpy(), found["n"].to_numpy()))

    def first(batches):
        import pyarrow as pa

        known, held_by = shared.value
        for batch in batches:
            for set_id, label, raw in zip(*[batch[c].to_pylist() for c in ("set_id", "label", "shingles")], strict=True):
                h = np.sort(np.frombuffer(raw, dtype=np.int64))
                n = np.zeros(len(h), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    n = np.where(known[at] == h, held_by[at], 0)
                m = len(h) - -(-len(h) * percent // 100) + 1
                h = h[np.argsort(n, kind="stable")[:m]]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([set_id] * m, pa.binary()), pa.array([label] * m, pa.binary()), pa.array([len(raw) // 8] * m, pa.int32()), pa.array(np.arange(1, m + 1, dtype=np.int32))], names=["shingle", "set_id", "label", "n", "place"])

    rows = scratch.write("first", full.select("set_id", "label", "shingles").mapInArrow(first, "shingle long, set_id binary, label binary, n int, place int"))
    groups = scratch.write("groups", majorities(rows, "shingle"))
    x, y = F.col("x_n"), F.col("y_n")
    room = 1 + F.least(x - F.col("x_place"), y - F.col("y_place"))
    fits = (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (room * (100 + percent) >= percent * (x + y))
    return crossing(rows, groups, "shingle", ["n", "place"], fits)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) for the ends of links (a, b): the least end reachable. Labels spread and jump until none changes."""
    n = 2 * links.count()
    arcs = scratch.write("arcs", links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).distinct(), n)
    labels = scratch.write("labels", arcs.groupBy("v").agg(F.least(F.first("v"), F.min("w")).alias("label")), n)
    while True:
        near = arcs.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        new = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = new.join(new.select(F.col("v").alias("label"), F.col("label").alias("next")), "label")
        moved = scratch.write("labels", jump.select("v", "old", F.col("next").alias("label")), n)
        if moved.where("label <> old").isEmpty():
            return moved.select("v", "label")
        labels = moved.select("v", "label")


def _links(pairs: DataFrame, classes: DataFrame, sets: Sets, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs, a written table, those that link: by their registers' estimate, then on full sets."""
    maybe = scratch.write("maybe", likely(pairs, classes, percent), pairs.count())
    return scratch.write("links", confirmed(maybe, sets, percent), maybe.count())


def _labelled(bands: DataFrame, labels: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The n rows of bands with their component's label, and the buckets that hold several."""
    rows = bands.select("key", "set_id").join(labels.withColumnRenamed("v", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    rows = scratch.write("labelled", rows, n)
    return rows, scratch.write("counts", majorities(rows, "key"), n)


def near_dedup(docs: DataFrame, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, group_id.

    Words are the runs without ASCII white space, A-Z lower-cased; a text of fewer than five words is
    one shingle; a null text or one without words has none and links with nothing. component_id is the
    smallest doc_id reachable by links, kept is doc_id = component_id. Rows that repeat an id share a
    component when their texts do; group_id, null where there are no words, tells components apart even
    then. A null id is the smallest of all and gives a null component_id. An empty table gives an empty
    result; other columns are not read. row names a column of docs, a long, which the result then has as
    well. A pair at exactly the threshold is missed with a probability of about 5e-6 (see above).
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write("rows", sketch(docs, row))
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min("k").alias("k"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = scratch.write("classes", classes, rows.count())
    width = 2 * ROWS
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", width * i + 1, width)) for i in range(BANDS)])).alias("key")
    bands = classes.select("set_id", keys)
    # What is known of keys is written before bands meet it: Spark can then split a key that very many share.
    shared = scratch.write("shared", bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    bands = scratch.write("bands", bands.join(shared, "key"))
    # Who shares the most buckets with the most others is likely to be in the middle of a group.
    n = bands.count()
    bands = scratch.write("bands", bands.drop("n").join(bands.groupBy("set_id").agg(F.sum("n").alias("degree")), "set_id"), n)
    sets = Sets(docs, classes, scratch, not rows.groupBy("k").count().where("count > 1").isEmpty())
    # First each bucket's members against the one of them that is most in the middle.
    hubs = scratch.write("hubs", bands.groupBy("key").agg(F.max(F.struct("degree", "set_id")).alias("h")).select("key", F.col("h.set_id").alias("hub")), n)
    pairs = bands.join(hubs, "key").where("hub <> set_id").select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct()
    tried = scratch.write("tried", pairs, n)
    links = _links(tried, classes, sets, percent, scratch)
    labels = components(links, scratch)

    # Then what is in different components of one bucket.
    labelled, counts = _labelled(bands, labels, n, scratch)
    if not (crowded := counts.where(F.col("meetings") > DENSE)).isEmpty():
        more = scratch.write("tried", second_hubs(labelled, crowded).join(tried, ["a", "b"], "left_anti"), n)
        tried, new = tried.union(more), _links(more, classes, sets, percent, scratch)
        if not new.isEmpty():
            links = links.union(new)
            labels = components(links, scratch)
            labelled, counts = _labelled(bands, labels, n, scratch)
    across = crossing(labelled, scratch.write("thin", counts.where(F.col("meetings") <= DENSE), n), "key")
    crowded = counts.where(F.col("meetings") > DENSE).select("key")
    if not crowded.isEmpty():
        dense = labelled.join(crowded, "key", "left_semi").select("set_id", "label").distinct()
        dense = scratch.write("dense", dense.join(classes.select("set_id", "n_shingles"), "set_id"), n)
        across = across.union(rare_pairs(dense, sets, percent, scratch)).distinct()
    new = _links(scratch.write("across", across.join(tried, ["a", "b"], "left_anti")), classes, sets, percent, scratch)
    if not new.isEmpty():
        labels = components(links.union(new), scratch)

    named = classes.select("set_id", "k").join(labels.withColumnRenamed("v", "set_id"), "set_id", "left").select("set_id", "k", F.coalesce("label", "set_id").alias("label"))
    smallest = named.groupBy("label").agg(F.min("k").alias("component"))
    of_set = scratch.write("of_set", named.join(smallest, "label").select("set_id", "component", F.hex("label").alias("group_id")), classes.count())
    none = F.lit(-(2**63))
    out = rows.drop("regs").join(of_set, "set_id", "left").withColumn("component", F.coalesce("component", "k"))
    return out.select(F.when(F.col("k") != none, F.col("k")).alias("doc_id"), "n_shingles", F.when(F.col("component") != none, F.col("component")).alias("component_id"), (F.col("k") == F.col("component")).alias("kept"), "group_id", *([] if row is None else [row]))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("group_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
arcs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, r) AS (SELECT a, a FROM arcs UNION SELECT arcs.b, r FROM reach JOIN arcs ON arcs.a = v),
c AS (SELECT v, min(r) AS component FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = d.doc_id
"""
