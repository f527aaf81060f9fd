import hashlib
import math
import random
import re
from collections import Counter

import pytest

from foliospark.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    x = [int(c) for c in d[::-1]]
    return (sum(x[::2]) + sum(y * 2 - 9 * (y > 4) for y in x[1::2])) % 10 == 0


def base(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.find(df).collect()
    want = sorted((i is None, i or 0, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base(t)).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in got) == want
    by_id = {i: base(t) for i, t, _ in rows}
    for r in got:
        found = r.spans.split(",") if r.spans else []
        mine = {f"{k}:{s}:{e}" for s, _, e, k in by_id[r.doc_id]}
        assert mine <= set(found) and len(found) == len(mine) + r.n_added
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in by_id[r.doc_id]) for x in PATTERNS)
    return got


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)


def test_odd_texts(spark):
    texts = ["", None, "a@b.c_x@d.e", "x@y@z.com.", "😀 é me@mail.org 😀 1.2.3.4.5.6.7.8", "300.1.1.1 0000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (266) 555-7228 nt", "+1 2", "1" * 30_000, "a." * 30_000 + "@b" + ".c" * 30_000, "+1" * 5000, "7 8 9 " * 3000, "a@b.cc, +49 170 1234567; 10.0.0.1", "me@x.de" * 3]
    check(spark, [(k, t, None) for k, t in enumerate(texts)] + [(None, "me@x.de", "y")])


def test_added(spark):
    texts = [f"contact me at name{k} (at) mail{k % 7} (dot) com or phone 0049 170 555{k:04d} today" for k in range(60)] + ["nothing at all dot here"] * 20
    got = check(spark, [(k, t, None) for k, t in enumerate(texts)])
    assert sum(r.n_added > 0 for r in got) >= 55 and not any(r.n_added for r in got if r.doc_id >= 60)


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def added(spark, texts):
    """The texts of added spans, by row."""
    got = check(spark, [(k, t, None) for k, t in enumerate(texts)])
    mine = {k: {f"{x}:{s}:{e}" for s, _, e, x in base(t)} for k, t in enumerate(texts)}
    cut = lambda t, span: t[int(span.split(":")[1]) : int(span.split(":")[2])]
    return {r.doc_id: [cut(texts[r.doc_id], x) for x in r.spans.split(",") if x and x not in mine[r.doc_id]] for r in got}


def test_spelled_at_alone(spark):
    hits = ["anna.schmidt [at] example.com", "natalie [at] data.org", "jan (at) firma.pl", "mia (at) skola (dot) se"]
    texts = [f"please ask {h}, thanks" for h in hits for _ in range(5)]
    for few in (texts[:1], texts):
        got = added(spark, few)
        assert all(got[k] == [hits[k // 5]] for k in range(len(few))), got


def test_prose_is_no_address(spark):
    prose = ["We met at noon. Then we left.", "She was at home. It rained.", "look at this. In the end", "he is at node.js now", "see database.com today", "that anecdotes tell", "Look at this.The end"]
    for texts in (prose, prose * 20, [f"{t} Ask jo [at] firma.pl, thanks" for t in prose] + prose * 20):
        got = added(spark, texts)
        assert not any(set(got[k]) - {"jo [at] firma.pl"} for k in got), got


def test_words_dates_and_years_are_no_spans(spark):
    """Alone, and beside many genuine spans."""
    odd = ["water.de", "see format.org now", "www.catalog.com", "patent.com", "on 2024-01-15 2023 it", "in 1984 05 17 2001 12 or", "years 1999 2000 2001 were", "from 1914-1918 and 1939-1945", "isbn 978 3 16 148410 0"]
    real = [f"mail me: jo{k} (at) site{k % 5}.org or call 0049 170 55{k:05d}, ok" for k in range(150)]
    for texts in (odd, odd + real):
        got = added(spark, texts)
        assert not any(got[k] for k in range(len(odd))), got
    # One number in ten passes Luhn and is a base card.
    assert sum(len(got[k]) == 2 for k in range(len(odd), len(texts))) >= 0.85 * len(real)


def test_expectation_maximisation_by_brute_force():
    """Against the same steps on single candidates, and against labelers whose reliabilities are known."""
    rng, rows = random.Random(0), []
    right = (0.9, 0.8, 0.7, 0.85, 0.6)
    for _ in range(3000):
        y = rng.random() < 0.4
        rows.append((y, tuple((1 if (rng.random() < p) == y else -1) if rng.random() < 0.8 else 0 for p in right)))
    counts = Counter(v for _, v in rows)
    like = pii.em([("card", v, n) for v, n in sorted(counts.items())])
    p = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v in rows]
    for _ in range(60):
        total = [sum(1 - x for x in p), sum(p)]
        rate = [[{x: (sum((q if y else 1 - q) for q, (_, v) in zip(p, rows) if v[j] == x) + 0.5) / (total[y] + 1.5) for x in (-1, 0, 1)} for j in range(5)] for y in (0, 1)]
        share = (total[1] + 1) / (len(rows) + 2)
        odds = {v: math.prod(rate[1][j][x] / rate[0][j][x] for j, x in enumerate(v)) * share / (1 - share) for v in counts}
        p = [odds[v] / (1 + odds[v]) for _, v in rows]
    assert all(abs(like["card", v] - q) < 1e-6 for q, (_, v) in zip(p, rows))
    assert sum((like["card", v] > 0.5) == y for y, v in rows) > 0.9 * len(rows)


def test_classifier_is_at_its_optimum():
    rng = random.Random(1)
    patterns, like = [], {}
    for _ in range(60):
        v, t = tuple(rng.choice((-1, 0, 1)) for _ in pii.VOTES), tuple(rng.randrange(2) for _ in pii.TRAITS)
        like["ip", v] = 1 / (1 + math.exp(-sum(v) - rng.random()))
        patterns.append(("ip", v, t, rng.randrange(1, 50)))

    def loss(w):
        z = [(sum(a * b for a, b in zip(w, (1, *v, *t))), like["ip", v], n) for _, v, t, n in patterns]
        return sum(n * (math.log1p(math.exp(x)) - y * x) for x, y, n in z) + pii.RIDGE / 2 * sum(a * a for a in w)

    w = pii.classifier(patterns, like)["ip"]
    assert all(loss(w) <= loss([a + d * (i == j) for i, a in enumerate(w)]) + 1e-9 for j in range(len(w)) for d in (-0.01, 0.01))


@pytest.mark.parametrize("filler", [0, 30])
def test_figures_and_sentences_are_no_personal_data(spark, filler):
    texts = ["GPS 52.5200 13.4050 here", "meet me @ noon. Thanks", "write to john dot doe at gmail dot com today", "mail jane @ example.com now", "call +49 30 1234567, or 030-123-4567", "\0\1 x@y.org \0"]
    texts += [f"mail user{k} at host{k} dot org, phone 030 555 01{k:02d}, see 10.1.{k}.7" for k in range(filler)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(rows).collect()}
    assert got[0] == got[1] == ""
    assert got[5] == "email:3:10"
    if filler:
        assert got[2] == "email:9:38"
