"""Personal data by weak supervision, in DataFrame functions alone.

Strict patterns give the base spans, which always stay. Wider patterns give candidates, on which five
labelers vote for, against or not at all: strict form, a gazetteer, words before, characters around, and
layout. Expectation-maximisation over the counts of vote patterns (at most 3^5 a kind) estimates how
reliable each labeler is and how likely each pattern is personal data. A logistic classifier is trained on
these likelihoods. It sees the votes and what they don't tell: how a span is written and what stands around
it. Candidates that it accepts, that are well-formed (as base spans must be, too) and that touch no base span
are added.

Wide email patterns take local parts of up to 64 characters and labels of up to 63, the longest that mail
addresses may have.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. Possessive quantifiers and look-behinds change no match: they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Written-out words stand apart or in capitals: the "at" and "dot" inside of words, as in "database", say nothing.
_OPEN, _CLOSE = r"(?:\x20?[\[({<]|\x20)", r"(?:[\])}>]\x20?|\x20)"
_AT, _DOT = (
    rf"(?:\x20?[\[({{<]?{sign}[\])}}>]?\x20?|{_OPEN}(?:{word.lower()}|{word}){_CLOSE}|(?<=[a-z0-9]){word}(?=[a-z0-9]))" for sign, word in (("@", "AT"), (r"\.", "DOT"))
)
#: What sets an address written with words apart from a sentence such as "we met at noon. Then".
MARKED = r"[\[({<]|(?<!\x20)@|@(?!\x20)|\x20(?:dot|DOT)\x20|[a-z0-9](?:AT|DOT)[a-z0-9]"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:\x20(?:dot|DOT)\x20[A-Za-z0-9_%+-]{{1,64}}){{0,3}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}})+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\x20?[\[({]?\.[\])}]?\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:00|\+)?\(?[0-9]{2,4}\)?[\x20./-]{0,2}\(?[0-9]{2,4}\)?(?:[\x20./-]{0,2}[0-9]{2,4}){1,4}(?![0-9])",
}
#: What a text must hold, each of them, for a wide pattern of the kind to be tried at all; base patterns need no less.
NEEDS = {"email": ("at|AT|@", r"dot|DOT|\."), "ip": ("[0-9]",), "card": ("[0-9]",), "phone": ("[0-9]",)}

# Last labels of mail domains, calling codes and card prefixes in common use, and cue words.
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|it|uk|us|eu|ch|at|nl|be|ca|mx|ar|br|ru|cn|jp|in"
CALLING = "1|33|34|39|41|43|44|45|46|47|48|49|31|32|351|353|358|52|54|55|61|7|81|82|86|91"
CARDS = "4[0-9]{12,18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}"
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|address",
    "ip": "ip|host|server|addr|client|login",
    "card": "card|visa|master|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobile|cell|ruf|appel|llama|contact|whatsapp|sms",
}
#: A year, or a date: groups of digits that phone numbers without a prefix rarely have.
YEAR = r"(?<![0-9])(?:1[0-9]|20)[0-9]{2}(?![0-9])"
AGAINST = "version|ver\\.|v\\.|isbn|issn|order|invoice|token|key|hash|page|chapter|section|no\\.|nr\\.|doi|price|total"


def matches(text: Column, pattern: str) -> Column:
    """Of each match in order: characters since the last one, some of them, the match, some that follow.

    The pattern is searched once: matches are marked by two control characters, which no pattern knows and which
    stand in for others in texts that have them, and the marked text is cut at these.
    """
    marked = F.regexp_replace(F.translate(text, "\0\1", "\2\2"), pattern, "\0$0\1")
    # [what precedes the first match], then [match, what follows] each.
    cells = F.transform(F.split(marked, "\0", -1), lambda x: F.split(x, "\1", -1))
    each = lambda e: F.transform(F.slice(e, F.lit(2), F.size(e)), lambda x, i: found(F.element_at(F.get(e, i), -1), x))
    found = lambda gap, x: F.struct(F.length(gap).alias("gap"), F.right(gap, F.lit(24)).alias("before"), F.get(x, F.lit(0)).alias("hit"), F.left(F.get(x, F.lit(1)), F.lit(8)).alias("after"))
    return F.get(F.transform(F.array(cells), each), F.lit(0))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Of a string of digits."""
    n = F.length(d)

    def step(total, i):
        x = F.substr(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    """The contract's conditions on a match of a base pattern."""
    d = digits(hit)
    n = F.length(d)
    parts = F.forall(F.split(hit, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == "email", True).when(kind == "ip", parts).when(kind == "card", F.when(n.between(12, 19), luhn(d)).otherwise(False)).otherwise(n.between(9, 15))


def spans(found: DataFrame, column: str) -> DataFrame:
    """row_id, kind, start, stop and the match with its surroundings, from arrays of matches by kind."""
    each = reduce(DataFrame.unionAll, [found.where(F.size(f"{column}_{k}") > 0).select("row_id", F.lit(k).alias("kind"), F.posexplode(f"{column}_{k}").alias("at", "m")) for k in KINDS])
    each = each.select("row_id", "kind", "at", "m.*").withColumn("size", F.length("hit"))
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return each.withColumn("stop", so_far.cast("long")).withColumn("start", F.col("stop") - F.col("size")).drop("at", "gap", "size")


VOTES = ["form", "listed", "cued", "edged", "laid_out"]
#: What the classifier sees beside the votes, 0 or 1: of the span and of its surroundings.
TRAITS = ["prefixed", "spaced", "even", "short", "opens_line", "after_mark", "ends_clause"]


def vote(c: DataFrame) -> DataFrame:
    """The labelers' votes on candidates: 1 for, -1 against, 0 for none; and the candidates' traits."""
    k, hit, d = F.col("kind"), F.col("hit"), digits(F.col("hit"))
    n, before, after = F.length(d), F.lower("before"), F.col("after")
    plain = F.regexp_replace(F.regexp_replace(hit, _AT, "@"), _DOT, ".")
    marked = hit.rlike(MARKED)
    prefixed = hit.rlike(r"^(?:\+|00|\()")
    octets = F.regexp_replace(hit, r"[^0-9.]", "")
    known = F.lower(plain).rlike(rf"\.(?:{DOMAINS})$")
    separators = F.regexp_replace(hit, "[0-9]", "")
    even = F.length(F.regexp_replace(separators, r"(.)(?=.*\1)", "")) <= 1
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    by_kind = lambda e, i, c, p: F.when(k == "email", e).when(k == "ip", i).when(k == "card", c).otherwise(p)
    either = lambda cond, other=no: F.when(cond, yes).otherwise(other)
    cue = reduce(lambda a, x: a | x, [(k == kind) & before.rlike(rf"(?:^|[^a-z])(?:e-?)?(?:{words})") for kind, words in CUES.items()])
    form = by_kind(
        # "at", or "@" between blanks, without any other sign is prose, unless a cue stands before, or a common domain behind "@".
        either(plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$") & (marked | ((cue | (hit.rlike("@") & known)) & ~hit.rlike(r"\.\x20")))),
        either(valid(F.lit("ip"), octets)),
        # Groups divided now by points and now by blanks are other figures, such as places on a map.
        either(F.when(n.between(12, 19), luhn(d) & even).otherwise(False)),
        either(n.between(9, 15) & (prefixed | (~hit.rlike(YEAR) & even))),
    )
    listed = by_kind(
        either(known, F.when(marked | cue, none).otherwise(no)),
        F.when(octets.rlike(r"^(?:0|127|255)\."), no).when(octets.rlike(r"^(?:[0-9]\.){3}[0-9]$"), no).otherwise(none),
        either(d.rlike(rf"^(?:{CARDS})$"), none),
        either(d.rlike(rf"^(?:00)?(?:{CALLING})[0-9]{{8,11}}$"), none),
    )
    cued = F.when(cue, yes).when(before.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]*$"), no).otherwise(none)
    edged = F.when(before.rlike(r"[A-Za-z0-9_=\"'#$€£-]$") | after.rlike(r"^[A-Za-z0-9_\"'%$€£]"), no).otherwise(yes)
    laid_out = by_kind(
        either(hit.rlike(r"[@\[({<]")),
        either(~hit.rlike(r"\x20")),
        either(separators.rlike(r"^(?:\x20{3}|-{3}|)$"), none),
        either(prefixed & ~hit.rlike(r"[./]{2}|\.[0-9]{1,2}\."), either(hit.rlike(r"^[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), no)),
    )
    votes = dict(zip(VOTES, (form, listed, cued, edged, laid_out), strict=True))
    traits = {
        "prefixed": prefixed,
        "spaced": F.contains(hit, F.lit(" ")),
        "even": even,
        "short": F.length(hit) <= 16,
        "opens_line": before.rlike(r"(?:^|\n)[\x20\t]*$"),
        "after_mark": before.rlike(r"[:=(,;]\x20?$"),
        "ends_clause": after.rlike(r"^(?:$|[\s,;.)!?])"),
    }
    # A part of a longer word or number is not well-formed, whatever it looks like.
    inside = before.rlike("[a-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    votes["form"] = F.when(inside, no).otherwise(votes["form"])
    return c.withColumns({name: column.cast("int") for name, column in (votes | traits).items()})


def em(patterns: list, rounds: int = 60) -> dict:
    """Likelihoods of being personal data by (kind, votes), from [(kind, votes, count)].

    Two classes a kind; given the class labelers vote independently, each by its own rates. It starts from
    the majority of votes. Rates are smoothed by half a vote each.
    """
    out = {}
    for kind in {p[0] for p in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        like = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows}
        for _ in range(rounds):
            total = [sum(n * (like[v] if y else 1 - like[v]) for v, n in rows) for y in (0, 1)]
            rate = [[{x: (sum(n * (like[v] if y else 1 - like[v]) for v, n in rows if v[j] == x) + 0.5) / (total[y] + 1.5) for x in (-1, 0, 1)} for j in range(len(VOTES))] for y in (0, 1)]
            share = (total[1] + 1) / (total[0] + total[1] + 2)
            for v, _ in rows:
                log = [math.log(p) + sum(math.log(rate[y][j][x]) for j, x in enumerate(v)) for y, p in ((0, 1 - share), (1, share))]
                like[v] = 1 / (1 + math.exp(max(-700.0, min(700.0, log[0] - log[1]))))
        out |= {(kind, v): p for v, p in like.items()}
    return out


#: Weight of the pull to 0 on the classifier's weights, in candidates.
RIDGE = 1.0


def classifier(patterns: list, like: dict, rounds: int = 30) -> dict:
    """Weights of a logistic classifier by kind, one of the kind and one for each vote and trait, from [(kind, votes,
    traits, count)]: fitted to the likelihoods of the votes by Newton's method."""
    import numpy as np

    out = {}
    for kind in {p[0] for p in patterns}:
        rows = [(v, t, n) for k, v, t, n in patterns if k == kind]
        x = np.array([(1, *v, *t) for v, t, _ in rows], dtype=float)
        y, n = np.array([like[kind, v] for v, _, _ in rows]), np.array([c for *_, c in rows], dtype=float)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
            step = np.linalg.solve(curve, x.T @ (n * (p - y)) + RIDGE * w)
            w = w - step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        out[kind] = w.tolist()
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Spans are kind:start:end in code points, by start and then kind, joined by commas. A null text is
    empty. Rows that repeat an id stay apart. Added spans keep to the four kinds and overlap neither base
    spans nor each other. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("text"))
    trial = lambda k, pattern: F.when(reduce(lambda a, b: a & b, [F.col("text").rlike(x) for x in NEEDS[k]]), matches(F.col("text"), pattern))
    found = scratch.write("found", plain.select("row_id", "doc_id", *[trial(k, BASE[k]).alias(f"base_{k}") for k in KINDS], *[trial(k, WIDE[k]).alias(f"wide_{k}") for k in KINDS]))
    base = spans(found, "base").where(valid(F.col("kind"), F.col("hit"))).select("row_id", "kind", "start", "stop", F.lit(True).alias("base"))
    base = scratch.write("base", base)
    candidates = vote(spans(found, "wide")).select("row_id", "kind", "start", "stop", *VOTES, *TRAITS)
    candidates = scratch.write("candidates", candidates)
    seen = candidates.groupBy("kind", *VOTES, *TRAITS).count().collect()  # at most 4 * 3^5 * 2^7 rows, however many candidates
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTES), tuple(r[t] for t in TRAITS), r["count"]) for r in seen)
    of_votes: dict = {}
    for kind, votes, _, n in patterns:
        of_votes[kind, votes] = of_votes.get((kind, votes), 0) + n
    weights = classifier(patterns, em([(k, v, n) for (k, v), n in sorted(of_votes.items())]))
    logit = F.lit(-1.0)
    for kind, w in weights.items():
        logit = F.when(F.col("kind") == kind, F.lit(w[0]) + reduce(lambda a, b: a + b, [F.col(v) * F.lit(x) for v, x in zip([*VOTES, *TRAITS], w[1:], strict=True)])).otherwise(logit)
    added = candidates.where("form = 1").where(logit > 0).select("row_id", "kind", "start", "stop", F.lit(False).alias("base"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    both = base.unionByName(added).withColumn("no", number)
    order = Window.partitionBy("row_id").orderBy("start", F.desc("base"), "no")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("ended", F.max(F.when(F.col("base"), F.col("stop"))).over(earlier)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(later))
    both = both.where(F.col("base") | ((F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("stop")))))
    # Among added spans the one that starts first stays: none that begins before another's end.
    both = both.withColumn("ended", F.max("stop").over(earlier)).where(F.col("base") | (F.coalesce("ended", F.lit(0)) <= F.col("start")))
    mark = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    listed = F.sort_array(F.collect_list(F.struct("start", "no", "stop", "kind", "base")))
    by_row = both.groupBy("row_id").agg(listed.alias("s"), *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS])
    by_row = by_row.select("row_id", *[f"n_{k}" for k in KINDS], mark(F.filter("s", lambda x: x["base"])).alias("base_spans"), mark(F.col("s")).alias("spans"), F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_added"))
    out = found.select("row_id", "doc_id").join(by_row, "row_id", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
