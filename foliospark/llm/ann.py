"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits at the median of a random projection. Every row is
then put into one leaf of each tree. A query walks all trees through one priority queue, nearest margins
first, until the leaves that it has reached hold a share of all distinct vectors. The share is measured on the
sample: there exact neighbours of some rows are known, and with them how far a walk must go to reach nearly all.
Clustered vectors need little, vectors without clusters much. Equal vectors count once in the sample and in walks,
so that a vector on very many rows neither fills the sample nor ends a walk. Leaves meet their queries in cells:
blocks of rows by blocks of queries, both of bounded size; there candidates are ranked by their exact cosine.
"""

import heapq
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

TREES, SAMPLE, LEAF = 8, 16_384, 64
#: Of the neighbours of PROBES rows of the sample, walks must reach this part; and LEAST rows in any case.
RECALL, PROBES, LEAST = 0.94, 256, 4096
#: Bytes of vectors, of rows and of queries alike, that meet in one cell; a block has FEWEST of them at least.
BLOCK, FEWEST = 4 << 20, 256
TOP = 5


class Tree:
    """Splits as arrays; a child under 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.directions, self.cuts, self.children, self.leaves = [], [], [], 0
        self._split(sample, leaf, rng)
        width = sample.shape[1]
        self.directions = np.array(self.directions).reshape(-1, width)

    def _split(self, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        low = None
        if len(rows) > leaf:
            direction = rng.standard_normal(rows.shape[1])
            direction /= np.linalg.norm(direction)
            at = rows @ direction
            cut = float(np.median(at))
            low = at <= cut
        if low is None or low.all() or not low.any():  # equal rows can't be split
            self.leaves += 1
            return -self.leaves
        me = len(self.cuts)
        self.directions.append(direction)
        self.cuts.append(cut)
        self.children.append(None)
        self.children[me] = (self._split(rows[low], leaf, rng), self._split(rows[~low], leaf, rng))
        return me

    def assign(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(0 if self.cuts else -1, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                low = rows[at] @ self.directions[node] <= self.cuts[node]
                todo += [(self.children[node][0], at[low]), (self.children[node][1], at[~low])]
        return out


def share_needed(sample: np.ndarray, trees: list[Tree], top: int, recall: float, probes: int) -> float:
    """The rows, as a share of the sample (of rows of length 1), in the leaves that walks must reach to meet a part
    recall of the top nearest others of evenly chosen rows. A row counts once a tree."""
    n = len(sample)
    leaf = [t.assign(sample) for t in trees]
    sizes = [np.bincount(x, minlength=t.leaves) for x, t in zip(leaf, trees, strict=True)]
    needed = []
    for i in np.unique(np.linspace(0, n - 1, min(n, probes)).astype(int)):
        near = sample @ sample[i]
        near[i] = -np.inf
        wanted = {int(j) for j in np.argsort(-near, kind="stable")[: min(top, n - 1)]}
        at: dict = {}
        for j in wanted:
            for k in range(len(trees)):
                at.setdefault((k, int(leaf[k][j])), set()).add(j)
        got = 0
        for k, x in reach(sample[i], trees, sizes, float("inf")):
            got += int(sizes[k][x])
            hit = at.get((k, x), set()) & wanted
            needed += [got] * len(hit)
            wanted -= hit
            if not wanted:
                break
    return float(np.quantile(needed, recall, method="higher")) / n if needed else 1.0


def reach(x: np.ndarray, trees: list[Tree], sizes: list[np.ndarray], wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of a shared priority queue, until their sizes add up to wanted."""
    margins = [t.directions @ x - np.array(t.cuts) if t.cuts else None for t in trees]
    queue = [(0.0, k, 0 if t.cuts else -1) for k, t in enumerate(trees)]
    out, got = [], 0
    while queue and got < wanted:
        far, k, node = heapq.heappop(queue)
        while node >= 0:
            m = margins[k][node]
            near, other = trees[k].children[node] if m <= 0 else trees[k].children[node][::-1]
            heapq.heappush(queue, (max(far, abs(m)), k, other))
            node = near
        out.append((k, -1 - node))
        got += int(sizes[k][-1 - node])
    return out


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def usable(vectors: DataFrame) -> DataFrame:
    """id and embedding as doubles, without those that take no part: no id, null, zero, null or non-finite parts."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
    return v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))


def neighbours(vectors: DataFrame, is_query, top: int = TOP, **how) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) with is_query, a condition
    on id, its nearest others by cosine, in double precision.

    Ties go to the smaller vec_id. Rows without id or embedding, zero vectors and those with null or non-finite
    parts take no part; vectors are compared with those of their own length, in a search for each length that
    there is. An id on several rows is never its own neighbour and is listed once, by its nearest row. A query
    with fewer candidates gets all. An empty table gives an empty result; other columns are not read. how: see
    search.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write("rows", usable(vectors))
    widths = {r["width"]: r["n"] for r in rows.groupBy(F.size("v").alias("width")).agg(F.approx_count_distinct(F.xxhash64("v")).alias("n")).collect()}
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [search(rows.where(F.size("v") == w), n, is_query, scratch, top, **how) for w, n in sorted(widths.items())]
    best = reduce(DataFrame.unionAll, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, n: int, is_query, scratch: Scratch, top: int, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, recall: float = RECALL, share: float | None = None, least: int = LEAST, block: int | None = None, seed: int = 5) -> DataFrame:
    """query_id, vec_id, score: at least the top best found of the written rows (id, v), of one length, for those with
    is_query. They hold about n distinct vectors.

    Trees are fitted on at most sample distinct vectors and split leaves of more than leaf of them. share sets what a
    query reaches, as a share of distinct vectors; by default it is measured so that a part recall of neighbours is
    met. block sets how many rows, and how many queries, meet in one cell, on average at most.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30))
    # A quarter more than asked for, since n is an estimate; the limit holds.
    some = rows.select("v", part.alias("part")).where(F.col("part") < F.lit(int((1 << 30) * min(1.0, 1.25 * sample / n)))).distinct()
    some = some.orderBy("part", "v").limit(sample).select("v").toPandas()["v"]
    fitted_on = np.stack(some.to_numpy()) if len(some) else np.ones((1, 1))
    fitted_on = fitted_on / np.linalg.norm(fitted_on, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    forest = [Tree(fitted_on, leaf, rng) for _ in range(trees)]
    block = block or max(FEWEST, BLOCK // (8 * fitted_on.shape[1]))

    def place(batches):
        import pyarrow as pa

        done = TaskContext.get().partitionId() << 33
        for batch in batches:
            v = _matrix(batch["v"])
            row = pa.array(np.arange(done, done + len(v)), pa.int64())
            done += len(v)
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            for k, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(tree.assign(u), pa.int32()), row, batch["id"], batch["v"]], names=["tree", "leaf", "row", "id", "v"])

    if share is None:
        share = share_needed(fitted_on, forest, top, recall, PROBES)
    index = scratch.write("index", rows.mapInArrow(place, "tree int, leaf int, row long, id long, v array<double>"))
    held, sizes = {}, [np.zeros(t.leaves, dtype=np.int64) for t in forest]
    for r in index.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("distinct")).collect():  # one row a leaf, of a number that the sample bounds
        held[r["tree"], r["leaf"]], sizes[r["tree"]][r["leaf"]] = r["n"], r["distinct"]
    wanted = max(least, share * n)

    def probe(batches):
        import pyarrow as pa

        done = TaskContext.get().partitionId() << 33
        for batch in batches:
            v = _matrix(batch["v"])
            for query, x in zip(batch["id"].to_pylist(), v, strict=True):
                found = [f for f in reach(x / np.linalg.norm(x), forest, sizes, wanted) if f in held]
                m = len(found)
                yield pa.RecordBatch.from_arrays([*[pa.array([f[j] for f in found], pa.int32()) for j in range(2)], pa.array([done] * m, pa.int64()), pa.array([query] * m, pa.int64()), pa.array([x.tolist()] * m, pa.list_(pa.float64()))], names=["tree", "leaf", "row", "id", "v"])
                done += 1

    probes = scratch.write("probes", rows.where(is_query).mapInArrow(probe, "tree int, leaf int, row long, id long, v array<double>"))
    asked = {(r["tree"], r["leaf"]): r["count"] for r in probes.groupBy("tree", "leaf").count().collect()}
    # Blocks go by rows' numbers, not by ids: one id may stand on very many rows. A leaf that no query reaches goes nowhere.
    cells = F.broadcast(spark.createDataFrame([(*k, -(-held[k] // block), -(-q // block)) for k, q in asked.items()], "tree int, leaf int, g_n int, h_n int"))
    own = lambda of: F.pmod(F.xxhash64("row", "id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    candidates = index.join(cells, ["tree", "leaf"]).select("tree", "leaf", own("g_n").alias("g"), every("h_n").alias("h"), "id", "v")
    queries = probes.join(cells, ["tree", "leaf"]).select("tree", "leaf", every("g_n").alias("g"), own("h_n").alias("h"), "id", "v")

    def meet(key, queries, candidates):
        import pyarrow as pa

        out: tuple = ([], [], [])
        if queries.num_rows and candidates.num_rows:
            q, c = _matrix(queries["v"].combine_chunks()), _matrix(candidates["v"].combine_chunks())
            q_ids, c_ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
            q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
            # The cut at top counts ids: where some stand on several rows, each by its nearest.
            order = np.argsort(c_ids, kind="stable")
            starts = np.flatnonzero(np.diff(c_ids[order], prepend=c_ids[order[0]] - 1))
            starts = starts if len(starts) < len(c_ids) else None
            for at in range(0, len(q), 256):
                near = (q[at : at + 256] / q_norm[at : at + 256, None]) @ (c / c_norm[:, None]).T
                near[q_ids[at : at + 256, None] == c_ids[None, :]] = -np.inf
                by_id = near if starts is None else np.maximum.reduceat(near[:, order], starts, axis=1)
                cut = np.partition(by_id, -min(top, by_id.shape[1]), axis=1)[:, -min(top, by_id.shape[1])] - 1e-9
                for j, (row, least_here) in enumerate(zip(near, cut, strict=True)):
                    likely = np.flatnonzero((row >= least_here) & np.isfinite(row))
                    # The same sum for the same vectors, wherever they stand.
                    exact = (c[likely] * q[at + j]).sum(axis=1) / (c_norm[likely] * q_norm[at + j])
                    best, taken = np.lexsort((c_ids[likely], -exact)), set()
                    for b in best:
                        i = int(c_ids[likely[b]])
                        if i not in taken:
                            taken.add(i)
                            out[0].append(int(q_ids[at + j]))
                            out[1].append(i)
                            out[2].append(float(exact[b]))
                            if len(taken) == top:
                                break
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    cell = ["tree", "leaf", "g", "h"]
    return queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(meet, "query_id long, vec_id long, score double")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
