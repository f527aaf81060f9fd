import hashlib

import pytest

from foliospark.llm import mixing as m


def plan(rows):
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return sizes, target, size
        capped |= over


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = m.mix(df).collect()
    assert got and len(got) == len(rows)
    sizes, target, size = plan(rows)
    of = {}
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        of.setdefault(r.source, []).append(r)
    for s, rs in of.items():
        # By hash, what comes next would be too much.
        h = lambda r: int(hashlib.md5(f"0:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16)
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        run, left = 0, target[s] - whole * sizes[s]
        for key in sorted({h(r) for r in rs}):
            run += sum(r.size for r in rs if h(r) == key)
            assert all(r.copies == whole + (run <= left + 1e-6) for r in rs if h(r) == key and r.size)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, m.mix(df).collect()), key=str)


def test_sources_of_all_kinds(spark):
    rows = [(k, "w " * (1 + k * 7 % 40), f"s{k % 5}") for k in range(300)] + [(k, "x y z", None) for k in range(300, 340)] + [(None, None, "s0"), (400, "", "lone"), (5, "a b", "s1"), (5, "a b", "s1"), (401, "one two three", "tiny"), (402, "long " * 3000, "s2")]
    check(spark, rows)


def test_few_rows(spark):
    check(spark, [(1, "a b", "x")])
    check(spark, [(1, "", None), (2, None, "z")])
    assert m.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
