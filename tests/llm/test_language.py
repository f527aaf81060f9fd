import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import language as lg


def test_grams_against_brute_force():
    grams = lg.Grams()
    one = lambda t: len(grams(t))
    assert [one(x) for x in ("", "123 .!", "a", "Ab", "a b", " a-1b? ")] == [0, 0, 1 + 2 + 1, 2 + 3 + 2, 2 + 4 + 3, 2 + 4 + 3]
    same = lambda a, b: np.array_equal(np.sort(grams(a)), np.sort(grams(b)))
    assert same("Straße, 12 ÜBER", "straße über") and not same("abc", "acb") and same(" a-1b? ", "a b")
    # A text's features are those of its n-grams, each as often as it stands there.
    text = " señor maña na "
    want = sorted(int(f) for n in lg.ORDERS for k in range(len(text) - n + 1) if n > 1 or text[k] != " " for f in [gram(text[k : k + n])])
    assert sorted(grams("Señor, maña na").tolist()) == want


def gram(s):
    mask = (1 << 64) - 1
    h = len(s)
    for c in s:
        h = (h + ord(c)) * 0x9E3779B97F4A7C15 & mask
        h ^= h >> 29
    return (h * 0xBF58476D1CE4E5B9 & mask) >> 32 & lg.FEATURES - 1


def test_one_pass_by_hand():
    z, n = np.zeros((3, 2)), np.zeros((3, 2))
    lg.pass_over((z, n), [(np.array([0, 2]), np.array([0.5, 1.0]), 1)])
    assert np.allclose(z, [[0.25, -0.25], [0, 0], [0.5, -0.5]]) and np.allclose(n, [[0.0625] * 2, [0] * 2, [0.25] * 2])
    w = lg.weights_of(z, n)
    assert math.isclose(w[0, 1], (0.25 - lg.L1) / ((lg.BETA + 0.25) / lg.ALPHA + lg.L2)) and not w[1].any()


def test_statistics_against_brute_force(spark):
    rows = [("a", "xy"), ("a", "xx"), ("b", "y1"), ("b", None), ("b", "12")]
    got = lg.statistics(spark.createDataFrame(rows, "lang string, text string").repartition(2)).collect()
    assert {r.lang: r.n for r in got if r.lang is not None} == {"a": 2, "b": 1}
    grams = lg.Grams()
    want = {}
    for _, text in rows:
        for f in set(grams(text or "").tolist()):
            want[f] = want.get(f, 0) + 1
    assert {r.feature: r.n for r in got if r.feature is not None} == want


@pytest.fixture(scope="module")
def answers(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return lg.op11_language(spark, sf_dir).join(truth, "doc_id").collect()


def test_held_out_accuracy_and_calibration(answers):
    unseen = [r for r in answers if r.held_out]
    assert len(answers) == 1000 and 150 < len(unseen) < 350
    right = [r.lang_pred == r.lang for r in unseen]
    assert np.mean(right) > 0.97
    assert abs(np.mean([r.score for r in unseen]) - np.mean(right)) < 0.05
    assert all(0 <= r.score <= 1 for r in answers)


def test_odd_rows(spark, tmp_path):
    rows = [(k, ["the cat sat on the mat", "le chat est sur la table"][k % 2] + f" {'abcdefgh'[k % 8]}", ["en", "fr"][k % 2], "x") for k in range(80)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "12 34 !", None, "x"), (None, "the mat", "en", "x"), (None, "la table", None, "x"), (103, "le chat " * 200_000, "fr", "x"), (5, "le chat", "fr", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lg.op11_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[100] == by[101] == by[102] == ["und"] and by[103] == ["fr"] and sorted(by[None]) == ["en", "fr"] and sorted(by[5]) == ["fr", "fr"]
    assert by[0] == ["en"] and by[1] == ["fr"]
    docs = spark.createDataFrame(rows[:2], "doc_id long, text string, lang string, score string")
    none = lg.identify(docs, lg.train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and set(none.columns) == {"doc_id", "lang", "lang_pred", "score"}
    one = lg.identify(docs, lg.train(docs.where("lang = 'fr'")))
    assert {(r.lang_pred, r.score) for r in one.collect()} == {("fr", 1.0)}
    assert lg.identify(docs.limit(0), lg.train(docs)).count() == 0


def test_reruns_agree(spark, answers):
    again = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in lg.op11_language(spark, "/root/testdata/sf0.01").select("doc_id", "lang_pred", F.col("score")).collect()}
    assert again == {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in answers}
