import math

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import ann


def brute(rows, top=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, dtype=float))
    out = []
    for i in sorted(good):
        if i % 50:
            continue
        found = {}
        for q in good[i]:
            for j, vs in good.items():
                if j != i:
                    s = max(float((q * v).sum() / (np.linalg.norm(q) * np.linalg.norm(v))) for v in vs)
                    found[j] = max(found.get(j, -2.0), s)
        out += [(i, k + 1, j, s) for k, (j, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top])]
    return out


def run(spark, rows, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(map(tuple, ann.neighbours(df, F.col("id") % 50 == 0, **args).collect()))


def test_small_tables_are_searched_whole(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = run(spark, rows, leaf=16), brute(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want))


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(8).astype("f4").tolist()) for k in range(40)]
    rows += [(None, rows[0][1]), (50, None), (100, [0.0] * 8), (101, [None] + [1.0] * 7), (102, [float("nan")] * 8), (103, [float("inf")] * 8), (104, [1.0]), (7, rows[7][1])]
    rows += [(200 + k, rows[0][1]) for k in range(30)]
    got, want = run(spark, rows, leaf=4), brute([r for r in rows if r[0] != 104])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    # Vectors of another length are compared with their like.
    short = [(400 + k, [1.0, float(k)]) for k in range(4)]
    assert [r[:3] for r in run(spark, rows + short, leaf=4)] == sorted([r[:3] for r in want] + [r[:3] for r in brute(short)])
    assert run(spark, [(0, [1.0, 2.0]), (1, [2.0])]) == []
    df = spark.createDataFrame([(0, [1.0, 2.0], 9.0, 1, "x"), (1, [2.0, 1.0], 9.0, 1, "x")], "vec_id long, embedding array<double>, score double, id int, v string")
    assert [r[:3] for r in map(tuple, ann.neighbours(df, F.col("id") % 50 == 0).collect())] == [(0, 1, 1)]
    assert run(spark, []) == [] and run(spark, [(0, [1.0, 2.0])]) == []
    (found,) = run(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])
    assert found[:3] == (0, 1, 1) and abs(found[3] - 0.8) < 1e-12


def exact_pairs(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x[::50] @ x.T
    near[np.arange(len(near)), np.arange(0, len(x), 50)] = -2
    return {(50 * q, int(j)) for q, found in enumerate(np.argsort(-near, axis=1)[:, :5]) for j in found}


def test_recall(spark):
    """With the query's own parameters, on vectors without clusters, which are the hardest, and on clustered ones."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((200, 64))
    for x in (rng.standard_normal((20_000, 64)), centres[rng.integers(0, 200, 20_000)] + 0.3 * rng.standard_normal((20_000, 64))):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {(r.query_id, r.vec_id) for r in ann.neighbours(df, F.col("id") % 50 == 0).collect()}
        want = exact_pairs(x)
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_share_of_rows_follows_the_data():
    rng = np.random.default_rng(3)
    share = {}
    for name, x in (("plain", rng.standard_normal((8000, 64))), ("clustered", rng.standard_normal((200, 64))[rng.integers(0, 200, 8000)] + 0.2 * rng.standard_normal((8000, 64)))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        forest = [ann.Tree(x, ann.LEAF, rng) for _ in range(ann.TREES)]
        share[name] = ann.share_needed(x, forest, 5, ann.RECALL, 64)
        assert ann.share_needed(x, forest, 5, 0.5, 64) < share[name]
    assert share["clustered"] < 0.1 < share["plain"] < 2


def test_repeated_rows_leave_room_for_others(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(8).astype("f4").tolist()) for k in range(120)]
    got, want = run(spark, rows * 6, leaf=1024), brute(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(want) == 15


def test_one_vector_on_a_third_of_all_rows(spark, monkeypatch):
    """Copies neither fill the sample nor end walks, and cells of rows and queries are small."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 16))
    hot = x[50].tolist()
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(50, hot)] * 1000 + [(4001 + k, hot) for k in range(1000)]
    cells = []
    real = ann.Scratch.write

    def write(self, name, df, n=None):
        out = real(self, name, df, n)
        if name in ("index", "probes"):
            cells.append(out)
        return out

    monkeypatch.setattr(ann.Scratch, "write", write)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.neighbours(df, F.col("id") % 50 == 0, sample=1000, least=0, block=64).collect()))
    want = brute(rows)
    assert [r for r in got if r[0] == 50] and [r[:3] for r in got if r[0] == 50] == [r[:3] for r in want if r[0] == 50]
    assert len(got) == len(want) and len({r[::2][:2] for r in got} & {r[::2][:2] for r in want}) >= 0.9 * len(want)
    index, probes = cells
    assert index.count() == 8 * len(rows)
    # Walks end before all leaves, and blocks are cut by rows although a third bear one id.
    assert probes.count() < 0.8 * index.select("tree", "leaf").distinct().count() * 1100
    assert probes.select("id", "row").distinct().count() == sum(i % 50 == 0 for i, _ in rows)


def test_cells_of_any_size_give_the_same(spark):
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((700, 8)))]
    want = [r[:3] for r in brute(rows)]
    for block in (30, 4096):
        assert [r[:3] for r in run(spark, rows, leaf=100, block=block)] == want
