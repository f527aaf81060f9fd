"""Spelling variants by permuterm rotations.

A word with a terminator behind it has as many rotations as characters. Without its last character, the one that is
edited, a rotation is the prefix that all words share which have another character in this place; a word that lacks
the character has the prefix as a whole rotation. So rotations are sorted by this prefix, and groups of equal prefixes
hold a word's neighbours: one replaced, inserted or deleted character apart. A group has at most one word for each
character that a word can have (90 of them), and one shorter word. Groups are scanned, and each member gets the number
of its neighbours there and the best of them; pairs are never made.

Prefixes of up to 256 characters are compared as they are, longer ones by two fingerprints of 61 bits, so that a word
of n characters costs time and space of n.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, table

#: The runs that count, and those of them that are long enough.
RUN, LEAST = r"[A-Za-zÀ-ÿ]", 7
#: A form is at least as many times as frequent as its word.
TIMES = 10
#: Words whose rotations one task makes.
TASK_WORDS = 20_000
#: Longer prefixes are fingerprinted.
LITERAL = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\0"
_PRIMES, _BASES = ((1 << 61) - 1, (1 << 61) - 31), (911_382_323_972_013, 972_663_749_103_251)


def count_words(docs: DataFrame, least_n: int = 2, run: str = RUN, least: int = LEAST, every: int = 31) -> DataFrame:
    """word, n of docs (doc_id, text): maximal runs, A-Z lower-cased. Where the crc32 of "<doc_id>:<run>" is divisible
    by every, the character at the crc32 modulo the length is left out. Words of at least least characters and least_n
    occurrences. A null text has no words; a null id counts as the empty text; rows that repeat an id count each."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{run}{{{least},}}"), F.lit(0))
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = docs.select(ids.alias("id"), F.explode(found).alias("w")).select("id", F.translate("w", _UPPER, _LOWER).alias("w"))
    h = F.crc32(F.concat_ws(":", "id", "w").cast("binary"))
    each = each.select("w", F.when(h % every == 0, h).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h").isNull(), F.col("w")).otherwise(F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2)))
    return each.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _fingerprints(text: str, size: int) -> list[str]:
    """Of all runs of size characters of text."""
    hashes = []
    for prime, base in zip(_PRIMES, _BASES, strict=True):
        top, h, out = pow(base, size - 1, prime), 0, []
        for c in text[:size]:
            h = (h * base + ord(c) + 1) % prime
        out.append(h)
        for gone, c in zip(text, text[size:]):
            h = ((h - (ord(gone) + 1) * top) * base + ord(c) + 1) % prime
            out.append(h)
        hashes.append(out)
    return [f"\1{size}:{a:x}:{b:x}" for a, b in zip(*hashes, strict=True)]


def rotations(word: str, literal: int = LITERAL) -> tuple[list[str], list[str]]:
    """For each character of a word the rotation that ends with it, without it; and all whole rotations."""
    n = len(word)
    around = word + _END + word + _END
    # The rotation that ends with the character at i begins behind it.
    short = [around[i + 1 : i + 1 + n] for i in range(n)] if n <= literal else _fingerprints(around[1 : 2 * n], n)
    whole = [around[i : i + n + 1] for i in range(n + 1)] if n + 1 <= literal else _fingerprints(around[: 2 * n + 1], n + 1)
    return short, whole


def near_words(words: DataFrame, literal: int = LITERAL) -> DataFrame:
    """id, n_near, best_n, best of words (id, word, n), ids in the words' order: how many words are one edit away, and
    of these the most frequent one (ties: the smallest id). Words without any are left out."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            some: tuple[list, ...] = ([], [], [], [])
            for i, word, n in zip(*[batch[c].to_pylist() for c in ("id", "word", "n")], strict=True):
                short, whole = rotations(word, literal)
                # kind 0: a character is replaced, or, where it is the first of its run, left out (1). 2: a whole word.
                some[0].extend(short + whole)
                some[1].extend([int(k == 0 or word[k - 1] != c) for k, c in enumerate(word)] + [2] * len(whole))
                some[2].extend([i] * (len(short) + len(whole)))
                some[3].extend([n] * (len(short) + len(whole)))
                if len(some[0]) > 50_000:
                    yield made(pa, some)
                    some = ([], [], [], [])
            yield made(pa, some)

    def made(pa, some):
        kinds = (pa.string(), pa.int8(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(some, kinds, strict=True)], names=["key", "kind", "id", "n"])

    bound_batches(words.sparkSession)
    each = words.select("id", "word", "n").mapInArrow(rows, "key string, kind byte, id long, n long")
    # Most frequent first, then by id: whoever comes first and isn't the member itself is its best neighbour.
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    groups = each.groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("m")).where(F.size("m") > 1)
    groups = groups.select("m", F.get(F.filter("m", lambda x: x["kind"] == 2), F.lit(0)).alias("whole"), F.filter("m", lambda x: x["kind"] < 2).alias("same"), F.filter("m", lambda x: x["kind"] == 1).alias("first"))

    def neighbours(x):
        # first and same each have at most one entry for each character, whole is one.
        others = F.filter("same", lambda y: y["id"] != x["id"])
        longer = F.when(F.col("whole").isNotNull() & (x["kind"] == 1), F.array(F.col("whole"))).otherwise(F.filter("m", lambda y: F.lit(False)))
        return F.when(x["kind"] == 2, F.col("first")).otherwise(F.concat(others, longer))

    best = lambda found: F.array_min(F.transform(found, lambda y: F.struct(y["less"].alias("less"), y["id"].alias("id"))))
    scanned = F.transform("m", lambda x: F.transform(F.array(neighbours(x)), lambda found: F.struct(x["id"].alias("id"), F.size(found).alias("near"), best(found).alias("best")))[0])
    found = groups.select(F.explode(scanned).alias("x")).select("x.*").where("near > 0")
    return found.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("b")).select("id", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.id").alias("best"))


def roots(scratch: Scratch, up: DataFrame) -> DataFrame:
    """id, root of up (id, form): the last of a chain of forms. Each round doubles the steps taken; a form is ten times
    as frequent as its word, so that chains are short."""
    reached = scratch.write("reached0", up.select("id", F.col("form").alias("root")))
    k = 0
    while True:
        further = reached.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        joined = reached.join(further, F.col("root") == F.col("_id"), "left")
        k += 1
        after = scratch.write(f"reached{k}", joined.select("id", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("id", "root")
        reached = after.select("id", "root")


def group_spellings(words: DataFrame, times: int = TIMES, literal: int = LITERAL) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), each word once.

    n_near is how many words are one inserted, deleted or replaced character away. A word's form is the most frequent
    of them (ties: the smallest by code points) if it is at least times as frequent, else null; its root is where its
    forms end, the word itself without any. Words may have any characters but code points 0 and 1. An empty table gives
    no rows; other columns are not read.
    """
    scratch = Scratch(words.sparkSession)
    # Ids grow with the words, so that ties are broken by ids, and long words are shuffled once.
    by_word = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    words = scratch.write("words", by_word)
    # A word has some twenty rotations: tasks are made for them, not for the words' few bytes.
    near = scratch.write("near", near_words(words.repartition(max(1, -(-words.count() // TASK_WORDS)), "id"), literal))
    found = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("best_n") >= times * F.col("n"), F.col(c)).alias(c) for c in ("best", "best_n")])
    up = scratch.write("up", found.where("best is not null").select("id", F.col("best").alias("form")))
    # Words with a form are few; theirs and the roots' names are looked up for them alone.
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    named = roots(scratch, up).join(up, "id").join(name("form"), "form").join(name("root"), "root").select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"))
    named = scratch.write("named", named)
    return found.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("best_n").alias("form_n"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return group_spellings(scratch.write("counted", count_words(table(spark, sf_dir, "documents"))))


#: The same in DuckDB: crc32 byte by byte (all characters have one or two), neighbours by what is left of a word without
#: one character.
OP12_SQL = f"""WITH RECURSIVE
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}{{{LEAST},}}')) AS r FROM documents),
low AS (SELECT doc_id, translate(r, '{_UPPER}', '{_LOWER}') AS w, count(*) AS n FROM runs GROUP BY ALL),
crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
bytes AS (SELECT w, n, t, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS b FROM low, crcs),
hashed AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes),
edited AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN words v ON c.rest = v.word UNION SELECT v.word, c.word, c.n FROM cuts c JOIN words v ON c.rest = v.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
ups AS (SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT u.word, f.form, u.steps + 1 FROM ups u JOIN forms f ON f.word = u.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, steps) AS root FROM ups GROUP BY word) USING (word)"""
