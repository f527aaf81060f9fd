import re
import zlib
from collections import Counter

import pytest

from foliospark.llm import spelling as sp


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n):
    by_length, near = {}, {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)]
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


WORDS = {
    "receive": 500, "recieve": 3, "receiive": 2, "eceive": 40, "receives": 50, "receivez": 5, "deceive": 50, "aaaaaaa": 30, "aaaaaaaa": 2, "aaaaaaaaa": 400, "éclairs": 20, "Éclairs": 2, "éclair": 9,
    "x" * 255: 2, "x" * 256: 30, "x" * 257: 400, "ab" * 150: 3, "ab" * 150 + "c": 90, "ab" * 149 + "cb": 90, "alone in": 2, "straße": 7, "strasse": 70, "strase": 700,
}


@pytest.mark.parametrize("literal", [4, 7, 256])
def test_groups_against_brute_force(spark, literal):
    words = spark.createDataFrame([(w, n, "x") for w, n in WORDS.items()], "word string, n long, id string")
    assert rows_of(sp.group_spellings(words, literal=literal)) == brute_groups(WORDS)
    assert sp.group_spellings(words.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, None), (None, "strangely strangely"), (7, ""), (7, "Strangely×strangelÿ STRANGELY"), (20, "long" * 50_000), (21, "long" * 50_000), (22, "long" * 50_000 + "s"), (23, "long" * 50_000 + "s")]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    n = brute_words(rows)
    got = rows_of(sp.op12_spelling(spark, str(tmp_path)))
    assert [r[:1] + r[3:4] for r in got] == sorted(n.items())
    short = {w: k for w, k in n.items() if len(w) < 1000}
    assert [r for r in got if len(r[0]) < 1000] == brute_groups(short)
    assert sorted(r[4] for r in got if len(r[0]) > 1000) == [1, 1]


def test_rotations_find_each_edit():
    short, whole = sp.rotations("abca")
    assert short == ["bca\0", "ca\0a", "a\0ab", "\0abc"] and whole == ["abca\0", "bca\0a", "ca\0ab", "a\0abc", "\0abca"]
    assert len(set(sp.rotations("abca", 2)[0])) == 4 and len(set(sp.rotations("abca", 2)[1])) == 5
