"""The pipeline's stages against what their operators decide, each on its own input."""

import corpus_pipeline as cp
from foliospark.llm import queries  # noqa: F401

from .test_near_dedup import brute
from .test_packing import hf_ids


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], sf_dir).collect(), docs.schema))
        assert kept[-1].columns == columns, name
    q, e, n, m = ([(r.doc_id, r.text) for r in k.collect()] for k in kept[1:])
    assert set(q) <= {(r.doc_id, r.text) for r in docs.collect()} and len(q) > 0.7 * docs.count()
    last = {}
    for i, t in sorted(q):
        last[t.encode().lower()] = i
    assert sorted(i for i, _ in e) == sorted(last.values())
    assert sorted(i for i, _ in n) == sorted(i for i, _, c in brute(e) if i == c)
    counts = {i: sum(x == i for x, _ in m) for i, _ in n}
    assert set(counts.values()) <= {0, 1, 2} and {i for i, _ in m} <= set(counts)
    packed = cp.STAGES[-1][1](spark, kept[-1], sf_dir).collect()
    assert sum(r.length for r in packed) == sum(len(x) + 1 for x in hf_ids([t for _, t in m]))


def test_run(spark, sf_dir):
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    assert cp.run(spark, sf_dir).count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, copies int, size string, target string, taken string, log_importance string, gumbel_key string, group_id string"
MINE = ("size", "target", "taken", "log_importance", "gumbel_key", "group_id")


def rows_of(spark, found):
    return spark.createDataFrame([(i, t, "en", s, 0, None, 7, *MINE) for i, t, s in found], SCHEMA)


def test_odd_rows(spark, sf_dir):
    docs = rows_of(spark, [(None, None, None), (1, "", "s"), (2, "one two three four five six", "s"), (2, "one two three four five six", "s"), (3, "One two three four five six", None)])
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), SCHEMA)
        assert all((r.copies, *r[7:]) == (7, *MINE) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 3}
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_rows_that_repeat_ids_are_decided_one_by_one(spark, sf_dir):
    a, b, c = ("same old words again and again " * 9).strip(), "quite another text that stands on its own here", "third text of which there is one only in all"
    near_a = a + " end"
    get = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in d.collect())
    docs = rows_of(spark, [(1, a, "s"), (2, a, "s"), (1, b, "s"), (2, a, "s"), (3, c, "s"), (3, c, "s"), (3, b.upper(), "s"), (None, None, "s"), (None, "", "s")])
    exact = get(cp.exact(spark, docs, sf_dir))
    assert exact[0][0] == -1 and exact[1:] == [(2, a), (3, b.upper()), (3, c)]
    docs = rows_of(spark, [(1, a, "s"), (5, near_a, "s"), (5, b, "s"), (5, b, "s"), (1, near_a, "s"), (6, c, "s"), (6, "", "s"), (6, None, "s")])
    near = get(cp.near(spark, docs, sf_dir))
    assert [x for x in near if x[1] in (a, near_a)] in ([(1, a)], [(1, near_a)])
    assert [x for x in near if x[1] not in (a, near_a)] == [(5, b), (6, ""), (6, ""), (6, c)]
