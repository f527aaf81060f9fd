import random

import numpy as np
import pytest

from foliospark.llm import near_dedup as nd


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {k: k for k in range(len(sets))}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(a)] = find(b)
    key = lambda i: -(2**63) if i is None else i
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), 2**63), key(i))
    return sorted((key(i), len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def check(spark, rows):
    got = nd.near_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")).collect()
    key = lambda i: -(2**63) if i is None else i
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "a b c d e"), (6, "a b c d e"), (7, "a b c d e f"), (None, "one two"), (None, "other words"), (8, "x " * 5000), (9, "x " * 4000)])
    assert nd.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("dense", "common", "part"), [(0, 2, 7), (3, 0, 7), (3, 10**6, nd.PART), (nd.DENSE, nd.COMMON, nd.PART)])
def test_groups_of_near_copies(spark, monkeypatch, dense, common, part):
    """By pairs in buckets, and by rare shingles in any order of them and in one or many parts."""
    monkeypatch.setattr(nd, "DENSE", dense)
    monkeypatch.setattr(nd, "COMMON", common)
    monkeypatch.setattr(nd, "PART", part)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(60)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    rows += [shared + [word() for _ in range(rng.randrange(5, 60))] for _ in range(60)]
    check(spark, [(k, " ".join(t)) for k, t in enumerate(rows)])


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    for size, overlap in ((1, 1.0), (40, 0.5), (3000, 0.75), (3000, 0.2), (20000, 0.9)):
        shared = round(2 * size * overlap / (1 + overlap))
        pool = rng.integers(1, 2**63, size=2 * size - shared, dtype=np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size - shared :])
        ra, rb = nd.registers(a), nd.registers(b)
        assert (nd.merge(ra, rb) == nd.registers(np.unique(pool))).all()
        found = nd.estimate(ra[None], rb[None], np.array([float(size)]), np.array([float(size)]))[0]
        assert abs(found - shared / (2 * size - shared)) < 0.2
