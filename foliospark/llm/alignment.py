"""Alignment of two tokenizers' ids by interval coalescing.

Both tokenizers cut a text, with a space before it, into tokens that are byte ranges. The tokens of a batch of
texts, A's and B's together, are put in order of their starts; where a start reaches the running maximum of the ends
before it a new group begins: these are the places where tokens of both end. Within groups each A token is expanded
to the B tokens that its range overlaps. Pairs of overlapping tokens are links; over all documents their counts say
which A id stands for a B id.
"""

import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, table
from .packing import Ids, default_tokenizer

#: Up to this many pairs of ids are broadcast; more go through a shuffled join.
BROADCAST_PAIRS = 1 << 20
#: Stands in B's ids before those of a piece of text that they don't give back.
_LOSSY = (1 << 32) - 1
_LETTER, _OTHER = r"[^\W\d_²³¹]", r"[\W\d_²³¹]"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteIds:
    """A: ids of texts as bytes (little-endian, unsigned, 32 bits), by a byte-level BPE. They always give a text back."""

    def __init__(self, path: str):
        import numpy as np

        self.encoding = Ids(path, added_tokens=False).encoding
        sizes = {i: len(x) for x, i in self.encoding._mergeable_ranks.items()}
        if sum(n == 1 for n in sizes.values()) < 256:
            raise ValueError("the byte-level vocabulary lacks bytes")
        self.lengths = np.zeros(max(sizes) + 1, np.int64)
        self.lengths[list(sizes)] = list(sizes.values())

    def __call__(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(self.encoding.encode_ordinary(x), "<u4").tobytes() for x in texts]


class PieceIds:
    """B: ids of texts (empty, or with a first space of their own) as bytes, by a sentencepiece BPE.

    Where no entry of the vocabulary goes on with white space, or holds letters beside other characters, texts are
    cut there; pieces of up to 64 characters are kept in a bounded cache. Tests hold the ids against the library's own.
    """

    def __init__(self, path: str, cached: int = 600_000):
        import numpy as np
        import sentencepiece

        self.cached, self.known = cached, {}
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [model.id_to_piece(i) for i in range(model.vocab_size())]
        usual = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(len(entries))]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(entries)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        words = [p.lstrip("▁") for p, u in zip(entries, usual, strict=True) if u]
        alone = [c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in words)]
        apart = all("▁" not in p and len({bool(re.match(_LETTER, c)) for c in p}) < 2 for p in words)
        # Where entries of the vocabulary cross such places, texts are encoded whole.
        self.first = "".join(alone[:1]) if apart else ""
        self.find = re.compile(rf" *{_LETTER}+|{_OTHER}+(?<! )| +").findall

    def cut(self, text: str) -> list[str]:
        return self.find(text) if self.first else [text] if text else []

    def encode(self, pieces: list[str]) -> list[list[int]]:
        # The library adds a space in front. What begins with one goes without it; other pieces go behind a character
        # that stands alone in the vocabulary.
        spaced = [x[0] == " " and (len(x) > 1 or not self.first) for x in pieces]
        found = self.model.encode([x[1:] if s else self.first + x for x, s in zip(pieces, spaced, strict=True)], num_threads=1) if pieces else []
        return [ids if s else ids[2:] for ids, s in zip(found, spaced, strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        """Puts into known what pieces give; before the ids of a piece that they don't give back stands a mark."""
        import numpy as np

        found = self.encode(pieces)
        ends = np.cumsum([len(ids) for ids in found])
        ids = np.fromiter(chain.from_iterable(found), "<u4", int(ends[-1]) if len(ends) else 0)
        raw = ids.tobytes()
        self.known.update(zip(pieces, map(raw.__getitem__, map(slice, [0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist()))))
        lengths = [len(x.encode()) for x in pieces]
        at = np.concatenate([[0], np.cumsum(self.lengths[ids])])[ends] if len(ends) else ends
        if not np.array_equal(at, np.cumsum(lengths)) or b"".join(map(self.bytes.__getitem__, ids.tolist())) != "".join(pieces).encode():
            for piece, one in zip(pieces, found, strict=True):
                if b"".join(map(self.bytes.__getitem__, one)) != piece.encode():
                    self.known[piece] = _LOSSY.to_bytes(4, "little") + self.known[piece]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 100):
            cut = [self.cut(x) for x in texts[at : at + 100]]
            if len(self.known) > self.cached:
                self.known.clear()
            self._learn(list(set().union(*cut).difference(self.known)))
            out += [b"".join(map(self.known.__getitem__, x)) for x in cut]
            for piece in {x for c in cut for x in c if len(x) > 64}:
                del self.known[piece]
        return out


def coalesce(a_ends, b_ends):
    """Of two ways to cut the same bytes, given by the ends of their tokens in order: the group of each A token and of
    each B token, numbered from 0."""
    import numpy as np

    n = len(a_ends)
    starts = np.concatenate([a_ends[:0], np.concatenate([[0], a_ends[:-1]])[:n], np.concatenate([[0], b_ends[:-1]])[: len(b_ends)]]).astype(np.int64)
    ends = np.concatenate([a_ends, b_ends])
    # By start, A before B: two sorted runs, which a stable sort merges.
    order = np.argsort(starts * 2 + (np.arange(len(ends)) >= n), kind="stable")
    reached = np.maximum.accumulate(ends[order])
    new = np.ones(len(ends), bool)
    new[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[:n], group[n:]


def overlaps(a_ends, b_ends):
    """Indexes of the A and of the B token of all pairs that overlap."""
    import numpy as np

    a_starts, b_starts = (np.concatenate([[0], x[:-1]])[: len(x)] for x in (a_ends, b_ends))
    first = np.searchsorted(b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - first
    of_a = np.repeat(np.arange(len(a_ends)), n)
    before = np.cumsum(n) - n
    return of_a, np.arange(len(of_a)) - np.repeat(before - first, n)


_COLUMNS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"
_GROUPS = "groups array<struct<start:long,stop:long,a:array<int>,b:array<int>>>"


def align(docs: DataFrame, byte_bpe: str | None = None, piece_bpe: str | None = None, with_groups: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): row (a number of its own), doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and its distinct pairs of linked ids (A's times 2^32 plus B's) with their counts; with_groups adds
    the groups themselves: their bytes (in a space and the text, end exclusive) and ids. For each batch of rows there
    is one more row, whose row is null, with the batch's pairs and counts.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros, no pairs
    and an empty groups_sha256. Special tokens' strings are plain text. Rows that repeat an id stay apart; an empty
    table gives no rows; other columns are not read. The tokenizers' files must be at the same paths on each executor.
    """
    paths = byte_bpe or default_tokenizer(), piece_bpe or default_pieces()
    bound_batches(docs.sparkSession)

    def rows(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        a_of, b_of, lossy = ByteIds(paths[0]), PieceIds(paths[1]), _LOSSY.to_bytes(4, "little")
        width = max(len(a_of.lengths), len(b_of.lengths))
        names = [f"{mark}{i}" for mark in ";,|" for i in range(width)].__getitem__
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            n = batch.num_rows
            texts = [" " + x if x else "" for x in batch["text"].to_pylist()]
            raw_a, raw_b = a_of(texts), b_of(texts)
            for i in [i for i, x in enumerate(raw_b) if lossy in x]:
                ids = np.frombuffer(raw_b[i], "<u4")
                ids = ids[ids != _LOSSY]
                back = b"".join([b_of.bytes[k] for k in ids.tolist()]) == texts[i].encode()
                raw_a[i], raw_b[i] = (raw_a[i], ids.tobytes()) if back else (b"", b"")
            a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (raw_a, raw_b))
            at_a, at_b = (np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]) for raw in (raw_a, raw_b))
            a_ends, b_ends = np.cumsum(a_of.lengths[a]), np.cumsum(b_of.lengths[b])
            del texts, raw_a, raw_b
            # Texts lie one behind the other, so that all of the batch are aligned at once.
            group_a, group_b = coalesce(a_ends, b_ends)
            of_a, of_b = overlaps(a_ends, b_ends)
            at_link = np.searchsorted(of_a, at_a)
            last = np.concatenate([[-1], group_a])[at_a]  # the group before each text's first
            n_groups = np.diff(last)

            order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
            is_b, ids = order >= len(a), np.concatenate([a, b])[order]
            mark = np.ones(len(order), np.int64)
            group = np.concatenate([group_a, group_b])[order]
            mark[:1], mark[1:] = 0, np.where(group[1:] != group[:-1], 0, np.where(is_b[1:] & ~is_b[:-1], 2, 1))
            shown, at_all = (mark * width + ids).tolist(), (at_a + at_b).tolist()
            digests = [hashlib.sha256("".join(map(names, shown[x:y]))[1:].encode()).hexdigest() if y > x else "" for x, y in zip(at_all, at_all[1:])]
            del shown, order, is_b, ids, mark, group

            pair = a[of_a] << 32 | b[of_b]
            distinct, place = np.unique(pair, return_inverse=True)
            by_text = np.repeat(np.arange(n), np.diff(at_link)) * max(1, len(distinct)) + place
            cells, counts = np.unique(by_text, return_counts=True)
            at_cell = np.searchsorted(cells, np.arange(n + 1) * max(1, len(distinct)))
            pairs = distinct[cells % max(1, len(distinct))] if len(distinct) else distinct
            lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
            columns = [
                pa.array(range(number, number + n), pa.int64()), batch["doc_id"], pa.array(np.diff(at_a), pa.int64()), pa.array(np.diff(at_b), pa.int64()),
                pa.array(n_groups, pa.int64()), pa.array(np.diff(at_link), pa.int64()), pa.array(digests, pa.string()),
                lists(at_cell, pairs, pa.int64()), lists(at_cell, counts, pa.int32()),
            ]
            kinds = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]
            if with_groups:
                total = int(last[-1]) + 1
                cut_a, cut_b = (np.searchsorted(g, np.arange(total + 1)) for g in (group_a, group_b))
                stop = a_ends[cut_a[1:] - 1]
                start = np.concatenate([[0], stop[:-1]])[:total]
                begun = np.repeat(np.concatenate([[0], a_ends])[at_a[:-1]], n_groups)
                parts = [pa.array(start - begun, pa.int64()), pa.array(stop - begun, pa.int64()), lists(cut_a, a, pa.int32()), lists(cut_b, b, pa.int32())]
                columns.append(pa.ListArray.from_arrays(pa.array(last + 1, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "stop", "a", "b"])))
                kinds.append("groups")
            number += n
            yield pa.RecordBatch.from_arrays(columns, names=kinds)
            if len(distinct):
                none = [pa.nulls(1, x.type) for x in columns]
                none[7:9] = [lists([0, len(distinct)], distinct, pa.int64()), lists([0, len(distinct)], np.bincount(place), pa.int32())]
                yield pa.RecordBatch.from_arrays(none, names=kinds)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, _COLUMNS + (f", {_GROUPS}" if with_groups else ""))


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n, best of what align() gave: how many links hold the two ids linked, and whether no other A
    id has more with the B id (ties included)."""
    each = aligned.where("row is null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    n = n.withColumns({"a_id": F.shiftright("pair", 32).cast("int"), "b_id": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")})
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id"))).select("pair", "a_id", "b_id", "n", "best")


def score(aligned: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of the documents of align(): links
    whose count is their B id's highest, and the sum of the counts of all links. counts is link_counts(), written."""
    counts = counts.select("pair", "n", "best")
    small = counts.count() <= most
    each = aligned.where("row is not null").select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("links"))
    sums = each.join(F.broadcast(counts) if small else counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = aligned.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return out.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    aligned = scratch.write("aligned", align(table(spark, sf_dir, "documents")))
    return score(aligned, scratch.write("counts", link_counts(aligned))).drop("row")
