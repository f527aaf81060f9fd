"""A Katz backoff model of any order, counted over all training texts and stored in partitioned tables.

Texts are read once and kept as blocks: a block has its distinct words' hashes and its documents as
indexes into them. What a block needs from the corpus it asks for in packed arrays, one row for each bucket,
so that a question costs bytes rather than rows: first its words' counts and numbers, then level by level
its n-grams' counts. Buckets add up what blocks report and answer in the order of the question; to n-grams
not seen in training they add what the backoff weight of the history needs. Histories stand for their words'
numbers, frequent words' are small. A history that stands before very many others is spread over several
buckets, whose shares of the weights of these few are added up afterwards. There are as many buckets as tokens call for.
Nothing that grows with the corpus goes to the driver or is broadcast.

p(w | h) = (c(h w) - off(c(h w))) / c(h) for a seen n-gram, else a(h) p(w | h'), h' being h without its first
word. off is what the level's Good-Turing discounts take off counts up to K (Katz's formula); greater counts
lose as much as a count of K, so that each history frees some mass. a(h) makes the probabilities after h add
up to one exactly; p(w) is discounted likewise and leaves what is freed to a single unknown word. After an
unseen h it is p(w | h'). Before a text stand as many starts as histories are long.
"""

import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, raw_texts, table, word_hasher

#: Words of the longest n-grams.
ORDER = 3
#: Good-Turing discounts apply to counts up to K.
K = 5
#: Text bytes of a block, and tokens that a bucket counts.
BLOCK, TOKENS = 6 << 20, 1 << 20
BLOCKS_AT_ONCE = 1
END = np.uint64(2)
FOLD = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "g long, n_tokens long, words binary, counts binary, doc_ids array<long>, held array<boolean>, lengths binary, tokens binary"


def taken_off(n: np.ndarray) -> np.ndarray:
    """Occurrences that discounts take off counts 0..K and, last, greater ones, from n[r], the number of
    types seen r times, r = 0..K + 1. Where counts of counts are too few for Good-Turing it is a half."""
    off = np.zeros(K + 2)
    limit = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        katz = (turing - limit) / (1 - limit) if limit < 1 else 0.0
        off[r] = r * (1 - katz) if 0 < katz < 1 else 0.5
    off[K + 1] = off[K]
    return off


class Unigrams:
    """p(w) by a word's count; what discounts free goes to one unknown word."""

    def __init__(self, total: int, types: int, n: np.ndarray):
        self.total, self.types, self.off = total, types, taken_off(n)
        low = n[1 : K + 1]
        freed = float((low * self.off[1 : K + 1]).sum() + (types - low.sum()) * self.off[K + 1])
        self.unknown = freed / total if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - self.off[np.minimum(c, K + 1)]) / max(1, self.total), self.unknown)


def seen_p(c: np.ndarray, history: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of n-grams seen c times after a history seen so often."""
    return (c - off[np.minimum(c, K + 1)]) / np.maximum(history, 1)


def _block(g: int, ids: list, held: list, words: list[np.ndarray]):
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    tokens = np.concatenate([x for w in words for x in (w, np.array([END]))])
    known, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # frequent words get small indexes, which pack well
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    at = place[at]
    trains = np.repeat(~np.array(held, dtype=bool), lengths)
    counts = np.bincount(at[trains], minlength=len(known)).astype("<i4")
    return g, len(tokens), known[order].tobytes(), counts.tobytes(), ids, held, lengths.astype("<i4").tobytes(), at.astype("<i4").tobytes()


def make_blocks(docs: DataFrame, held_out_mod: int = 7, held_out_at: int = 2, size: int = BLOCK) -> DataFrame:
    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        schema = pa.schema(list(zip(["g", "n_tokens", "words", "counts", "doc_ids", "held", "lengths", "tokens"], kinds, strict=True)))
        g, hasher = TaskContext.get().partitionId() << 32, word_hasher()
        ids, held, words, held_bytes = [], [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_block(g, ids, held, words), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), raw_texts(batch["text"]), strict=True):
                ids.append(doc_id)
                held.append(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % held_out_mod == held_out_at)
                words.append(hasher(raw))
                held_bytes += len(raw)
                if held_bytes >= size:
                    yield made()
                    g, ids, held, words, held_bytes = g + 1, [], [], [], 0
        if ids:
            yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(blocks, BLOCKS)


def _u64(x) -> np.ndarray:
    return np.frombuffer(x, dtype="<u8")


def _i4(x) -> np.ndarray:
    return np.frombuffer(x, dtype="<i4")


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers of 0 or more, each array in as few bytes as its greatest needs, equal places together."""
    head, body = [len(arrays)], []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        head += [len(x), width]
        body.append(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, dtype="<i8").tobytes() + b"".join(body))


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for size, width in head.reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += size * width
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray):
    """The order that sorts by bucket and keeps it otherwise, and (bucket, from, to) for each that is there."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(order)]))
    return order, [(int(sorted_[a]), a, b) for a, b in zip(starts, ends, strict=True) if b > a]


def _table(names: list[str], kinds: list, rows: list):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(x, getattr(pa, t)()) for x, t in zip(columns, kinds, strict=True)], names=names)


def _batch(*args):
    return _table(*args).combine_chunks().to_batches(max_chunksize=1 << 20)


def ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for g, words, counts in zip(*[batch[c].to_pylist() for c in ("g", "words", "counts")], strict=True):
                w, n = _u64(words), _i4(counts)
                order, parts = _by_bucket(_bucket(w, buckets))
                w, n = w[order], n[order]
                yield from _batch(["bucket", "g", "words", "a"], ["int64", "int64", "binary", "binary"], [(k, g, w[a:b].tobytes(), _pack(n[a:b])) for k, a, b in parts])

    return blocks.select("g", "words", "counts").mapInArrow(ask, "bucket long, g long, words binary, a binary")


ANSWER = "kind int, g long, bucket long, a binary, b binary"
ANSWERS, TALLY, WEIGHTS, WANTED = range(4)


def _answers(rows: list):
    return _table(["kind", "g", "bucket", "a", "b"], ["int32", "int64", "int64", "binary", "binary"], rows)


def _tally(counts: np.ndarray) -> bytes:
    """Sum, number and numbers of 0..K + 1 of the counts over 0."""
    low = np.bincount(counts[counts <= K + 1], minlength=K + 2)
    return np.concatenate(([counts.sum(), (counts > 0).sum()], low)).astype("<i8").tobytes()


def count_words(asked: DataFrame, buckets: int) -> DataFrame:
    """Answers: a word's count, and its number: smaller ones are oftener, 0 is the start's."""

    def count(found):
        g, words = found["g"].to_pylist(), [_u64(x) for x in found["words"].to_pylist()]
        bucket = found["bucket"][0].as_py()
        ends = np.cumsum([len(w) for w in words])[:-1]
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.concatenate([_unpack(x)[0] for x in found["a"].to_pylist()])
        total = np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)
        number = np.empty(len(known), dtype=np.int64)
        number[np.argsort(-total, kind="stable")] = 1 + bucket + np.arange(len(known)) * buckets
        rows = [(ANSWERS, x, bucket, _pack(c, n), None) for x, c, n in zip(g, np.split(total[at], ends), np.split(number[at], ends), strict=True)]
        return _answers([*rows, (TALLY, -1, bucket, _tally(total), None)])

    return asked.groupBy("bucket").applyInArrow(count, ANSWER)


def tally(answers: DataFrame) -> np.ndarray:
    """One short array from each bucket, added up."""
    rows = [np.frombuffer(r["a"], dtype="<i8") for r in answers.where(F.col("kind") == TALLY).select("a").toLocalIterator()]
    return sum(rows, np.zeros(K + 4, dtype=np.int64))


def answered(answers: DataFrame, name: str, files: int) -> DataFrame:
    """g and the array of its answers."""
    return answers.repartition(files, "g").groupBy("g").agg(F.collect_list(F.struct("kind", "bucket", "a", "b")).alias(name))


class Words:
    """A block's words in the order of their numbers, the start at 0, and where its tokens find them."""

    def __init__(self, words: bytes, tokens: bytes, answers: list, buckets: int):
        h, found = _u64(words), {r["bucket"]: r["a"] for r in answers}
        c, number = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        order, parts = _by_bucket(_bucket(h, buckets))
        for k, a, b in parts:
            c[order[a:b]], number[order[a:b]] = _unpack(found[k])
        sorted_ = np.argsort(number)
        place = np.empty(len(h), dtype=np.int64)
        place[sorted_] = np.arange(1, len(h) + 1)
        self.at = place[_i4(tokens)]
        # As many texts start as end.
        texts = c[np.flatnonzero(h == END)]
        self.c, self.number = np.concatenate((texts, c[sorted_])), np.concatenate(([0], number[sorted_]))
        self.hash = mix64(self.number.astype(np.uint64))

    def columns(self, which: np.ndarray) -> list[np.ndarray]:
        return [self.number[which]]


class Grams:
    """A block's distinct n-grams in the order of their words' numbers, starts alone at 0. below has those a word shorter.

    context is an n-gram's history and lower what it is without its first word, as places in below.
    """

    def __init__(self, below: "Words | Grams", words: Words, first: np.ndarray, buckets: int, tokens: int):
        self.below, self.words = below, words
        before = np.concatenate(([0], below.at[:-1]))
        before[first] = 0
        width = len(words.c)
        key, at = np.unique(before * width + words.at, return_inverse=True)
        key = np.concatenate(([0], key))
        self.at = at + 1
        self.context, self.last = key // width, key % width
        self.lower = np.zeros(len(key), dtype=np.int64)
        self.lower[self.at] = below.at
        self.of = below.c[self.context]
        spread = self.of // tokens * 4 + 1
        self.hot = self.of >= tokens
        salt = np.where(self.hot, mix64(words.number[self.last].astype(np.uint64)) % spread.astype(np.uint64), 0).astype(np.uint64)
        self.home = _bucket(below.hash, buckets)
        bucket = _bucket(mix64(below.hash[self.context[1:]] + salt[1:] * FOLD), buckets)
        order, self.parts = _by_bucket(bucket)
        self.order = order + 1

    @property
    def hash(self) -> np.ndarray:
        return mix64(self.below.hash[self.context] * FOLD + self.words.number[self.last].astype(np.uint64))

    def columns(self, which: np.ndarray) -> list[np.ndarray]:
        """The numbers of their words."""
        return [*self.below.columns(self.context[which]), self.words.number[self.last[which]]]

    def question(self, a: int, b: int, counts: np.ndarray) -> bytes:
        """Histories, whether they are spread, how often their ends were seen, numbers of last words; last words, how often
        the block's training texts have the n-gram, and the corpus' have the lower one."""
        which = self.order[a:b]
        new = np.flatnonzero(np.diff(self.context[which], prepend=-1))
        h = which[new]
        histories = self.below.columns(self.context[h])
        histories[0] = np.diff(histories[0], prepend=0)
        ends = self.below.of[self.lower[h]] if isinstance(self.below, Grams) else np.empty(0, dtype=np.int64)
        runs = np.diff(np.append(new, b - a))
        return _pack(*histories, self.hot[h], ends, runs, self.words.number[self.last[which]], counts[which], self.below.c[self.lower[which]])

    def read(self, answers: list, off: np.ndarray | None = None) -> None:
        """Counts and, given the level's discounts, what histories of unseen n-grams need for their weights."""
        found = {(r["kind"], r["bucket"]): r for r in answers}
        self.c = np.zeros(len(self.context), dtype=np.int64)
        self.c[0] = self.of[0]
        if off is not None:
            self.free, self.p_seen = np.zeros(len(self.below.c)), np.zeros(len(self.below.c))
        for k, a, b in self.parts:
            which, row = self.order[a:b], found[ANSWERS, k]
            counts, low = _unpack(row["a"])
            self.c[which] = counts
            if off is not None:
                h = np.unique(self.context[which[counts == 0]])
                self.free[h] = low.reshape(-1, K + 1) @ off[1:]
                self.p_seen[h] = np.frombuffer(row["b"], dtype="<f8")
        if off is not None:
            mine, parts = self.spread()
            for k, a, b in parts:
                row = found[WEIGHTS, k]
                self.free[mine[a:b]] = _unpack(row["a"])[0].reshape(-1, K + 1) @ off[1:]
                self.p_seen[mine[a:b]] = np.frombuffer(row["b"], dtype="<f8")

    def spread(self):
        """The histories that are spread, and these by bucket."""
        mine = np.unique(self.context[1:][self.hot[1:]])
        order, parts = _by_bucket(self.home[mine])
        return mine[order], parts

    def p(self, unigrams: Unigrams, offs: list[np.ndarray]) -> np.ndarray:
        """Of each n-gram's last word after its history: by its own count, else by the n-gram a word shorter."""
        below = unigrams.p(self.below.c) if isinstance(self.below, Words) else self.below.p(unigrams, offs[:-1])
        h, of = self.context, np.maximum(self.of, 1)
        back = np.where(self.of > 0, self.free[h] / of / (1 - self.p_seen[h]), 1.0)
        return np.where(self.c > 0, seen_p(self.c, self.of, offs[-1]), back * below[self.lower])


PARTS = ["g", "words", "lengths", "tokens", "held"]


def _levels(row: dict, buckets: int, tokens: int, to: int, offs: list | None = None) -> list:
    """A block's words and n-grams of 2 to to words; those below to with their counts, and with offs all of them."""
    words = Words(row["words"], row["tokens"], row["level_1"], buckets)
    lengths = _i4(row["lengths"]).astype(np.int64)
    first, out = np.cumsum(lengths) - lengths, [words]
    for n in range(2, to + 1):
        grams = Grams(out[-1], words, first, buckets, tokens)
        if n < to or offs is not None:
            grams.read(row[f"level_{n}"], offs[n - 2] if offs else None)
        out.append(grams)
    return out


def ask_grams(blocks: DataFrame, buckets: int, tokens: int, n: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = _levels(row, buckets, tokens, n)[-1]
                trains = np.repeat(~np.array(row["held"], dtype=bool), _i4(row["lengths"]))
                counts = np.bincount(grams.at[trains], minlength=len(grams.context))
                mine, parts = grams.spread()
                rows = [(k, row["g"], None, _pack(*grams.below.columns(mine[a:b]))) for k, a, b in parts]
                rows += [(k, row["g"], grams.question(a, b, counts), None) for k, a, b in grams.parts]
                yield from _batch(["bucket", "g", "a", "spread"], ["int64", "int64", "binary", "binary"], rows)

    return blocks.select(*PARTS, *[f"level_{k}" for k in range(1, n)]).mapInArrow(ask, "bucket long, g long, a binary, spread binary")


def _ids(columns: list[np.ndarray]):
    """A number for each distinct row of columns, and one of its places."""
    at = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        value, v_at = np.unique(c, return_inverse=True)
        _, at = np.unique(at * len(value) + v_at, return_inverse=True)
    place = np.empty(int(at.max()) + 1, dtype=np.int64)
    place[at] = np.arange(len(at))
    return at, place


def count_grams(asked: DataFrame, buckets: int, n: int, unigrams: Unigrams, off_below: np.ndarray | None) -> DataFrame:
    """Answers: counts; and for the histories of n-grams not seen, what weights need: numbers of followers seen 1..K times and
    oftener, and the sum of their probabilities by the level below. Of spread histories each bucket gives its share, and
    who wants them is passed on."""

    def count(found):
        bucket, wanted = found["bucket"][0].as_py(), found.filter(found["spread"].is_valid())
        rows = [(WANTED, x, bucket, a, None) for x, a in zip(wanted["g"].to_pylist(), wanted["spread"].to_pylist(), strict=True)]
        found = found.filter(found["a"].is_valid())
        if not found.num_rows:
            return _answers(rows)
        g, messages = found["g"].to_pylist(), [_unpack(x) for x in found["a"].to_pylist()]
        for m in messages:
            m[0] = np.cumsum(m[0])
        whole = [np.concatenate(x) for x in zip(*messages, strict=True)]
        histories, (hot, ends, runs, words, counts, lower) = whole[: n - 1], whole[n - 1 :]
        h_at, h_place = _ids(histories)
        of_entry = np.repeat(h_at, runs)
        w, w_at = np.unique(words, return_inverse=True)
        gram, at = np.unique(of_entry * len(w) + w_at, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(gram)).astype(np.int64)
        c_lower = np.empty(len(gram), dtype=np.int64)
        c_lower[at] = lower
        seen = total > 0
        of, c = (gram // len(w))[seen], total[seen]
        p = unigrams.p(c_lower[seen]) if n == 2 else seen_p(c_lower[seen], ends[h_place[of]], off_below)
        p_seen = np.bincount(of, weights=p, minlength=len(h_place))
        low = np.bincount(of * (K + 1) + np.minimum(c, K + 1) - 1, minlength=len(h_place) * (K + 1)).reshape(-1, K + 1)
        answer = total[at]
        size, sizes = np.cumsum([len(m[-1]) for m in messages])[:-1], [len(m[n - 1]) for m in messages]
        start = 0
        for x, mine, of_mine, k in zip(g, np.split(answer, size), np.split(of_entry, size), sizes, strict=True):
            # Histories come in the order of the question, which is that of their first entries.
            lost = np.zeros(len(h_place), dtype=bool)
            lost[of_mine[mine == 0]] = True
            asked_for = h_at[start : start + k]
            h = asked_for[lost[asked_for]]
            rows.append((ANSWERS, x, bucket, _pack(mine, low[h].reshape(-1)), p_seen[h].tobytes()))
            start += k
        rows.append((TALLY, -1, bucket, _tally(total), None))
        shared = np.flatnonzero((hot[h_place] > 0) & (np.bincount(of, minlength=len(h_place)) > 0))
        if len(shared):
            columns = [x[h_place[shared]] for x in histories]
            order, parts = _by_bucket(_bucket(_hash(columns), buckets))
            rows += [(WEIGHTS, -1, k, _pack(*[x[order[a:b]] for x in columns], low[shared[order[a:b]]].reshape(-1)), p_seen[shared[order[a:b]]].tobytes()) for k, a, b in parts]
        return _answers(rows)

    return asked.groupBy("bucket").applyInArrow(count, ANSWER)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = mix64(columns[0].astype(np.uint64))
    for c in columns[1:]:
        h = mix64(h * FOLD + c.astype(np.uint64))
    return h


def answer_weights(answers: DataFrame) -> DataFrame:
    """For each spread history that a block wants, its shares added up."""

    def answer(key, parts, questions):
        if not questions.num_rows or not parts.num_rows:
            return _answers([])
        known = [_unpack(x) for x in parts["a"].to_pylist()]
        wanted = [_unpack(x) for x in questions["a"].to_pylist()]
        columns = [np.concatenate(x) for x in zip(*[m[:-1] for m in known], *wanted, strict=True)]
        at, place = _ids(columns)
        n = sum(len(m[0]) for m in known)
        low = np.zeros((len(place), K + 1), dtype=np.int64)
        np.add.at(low, at[:n], np.concatenate([m[-1] for m in known]).reshape(-1, K + 1))
        p = np.bincount(at[:n], weights=np.concatenate([np.frombuffer(x, dtype="<f8") for x in parts["b"].to_pylist()]), minlength=len(place))
        rows = []
        for g, m in zip(questions["g"].to_pylist(), wanted, strict=True):
            mine = at[n : n + len(m[0])]
            rows.append((WEIGHTS, g, key[0].as_py(), _pack(low[mine].reshape(-1)), p[mine].tobytes()))
            n += len(m[0])
        return _answers(rows)

    shares, asked = (answers.where(F.col("kind") == x).select("bucket", "g", "a", "b") for x in (WEIGHTS, WANTED))
    return shares.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, ANSWER)


def score_blocks(blocks: DataFrame, buckets: int, tokens: int, order: int, unigrams: Unigrams, offs: list) -> DataFrame:
    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                levels = _levels(row, buckets, tokens, order, offs)
                words, top = levels[0], levels[-1]
                p = unigrams.p(words.c) if order == 1 else top.p(unigrams, offs)
                lengths = _i4(row["lengths"]).astype(np.int64)
                counts, starts, total = words.c[words.at], np.cumsum(lengths) - lengths, unigrams.total
                base = np.log10((counts + 1.0) / (total + unigrams.types + 1.0))
                add = lambda x: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(add((counts > 0).astype(np.int64))), pa.array(np.full(len(lengths), total, dtype=np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)[top.at]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return blocks.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_scores(docs: DataFrame, held_out_mod: int = 7, held_out_at: int = 2, block_bytes: int = BLOCK, order: int = ORDER, bucket_tokens: int = TOKENS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the runs without ASCII white space, A-Z lower-cased, and one end. Texts whose id's crc32 mod
    held_out_mod is held_out_at teach nothing. score is the model's log10 probability of the text's tokens by
    n-grams of up to order words; base_score that of add-one word counts. A null text has the end alone; a null id
    trains. Without training texts every token is the one unknown word: both scores are 0. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    files = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bucketed by block, as answers are: joins move neither.
    tables = []

    def by_block(name: str, df: DataFrame) -> DataFrame:
        tables.append(f"foliospark_{name}_{scratch.top[-32:]}")
        scratch.paths[name] = f"{scratch.top}/{name}"
        df.write.option("path", scratch.paths[name]).option("compression", "zstd").bucketBy(files, "g").format("parquet").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    # Blocks are long rows: Python gets a few at once.
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows)
    try:
        blocks = by_block("blocks", make_blocks(docs, held_out_mod, held_out_at, block_bytes))
        spark.conf.set(rows, str(BLOCKS_AT_ONCE))
        return _scores(blocks, scratch, by_block, files, order, bucket_tokens)
    finally:
        spark.conf.set(rows, usual)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scores(blocks: DataFrame, scratch: Scratch, by_block, files: int, order: int, tokens: int) -> DataFrame:
    buckets = max(files, (blocks.agg(F.sum("n_tokens")).first()[0] or 0) // tokens + 1)
    kept = lambda answers: answers.where(F.col("kind") == ANSWERS)
    answers = scratch.write("counted_1", count_words(ask_words(blocks, buckets), buckets))
    counted = tally(answers)
    unigrams, offs = Unigrams(int(counted[0]), int(counted[1]), counted[2:]), []
    known = blocks.join(by_block("level_1", answered(kept(answers), "level_1", files)), "g")
    for n in range(2, order + 1):
        asked = ask_grams(known, buckets, tokens, n)
        scratch.drop(f"counted_{n - 1}")
        answers = scratch.write(f"counted_{n}", count_grams(asked, buckets, n, unigrams, offs[-1] if offs else None))
        offs.append(taken_off(tally(answers)[2:]))
        known = known.join(by_block(f"level_{n}", answered(kept(answers).union(answer_weights(answers)), f"level_{n}", files)), "g")
    scores = scratch.write("scores", score_blocks(known, buckets, tokens, order, unigrams, offs))
    scratch.drop(*[x for x in list(scratch.paths) if x != "scores"])
    return scores


def op4_katz(spark, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
