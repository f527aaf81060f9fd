"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the powers of two of n's binary form, with as
many pieces of max_len as fit first. Pieces of one length form a bucket; each is a sequence by itself,
so none crosses documents and none needs padding. Nothing is shuffled.
"""

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, table

MAX_LEN = 1024
END_ID = 0

# Code points up to U+017F by the classes of the tokenizer's pattern.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\\t-\\r \u0085 "
_FAST = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """A text's ids as little-endian 32-bit bytes, by the byte-level BPE of a tokenizers file.

    The pieces that merges can't leave are looked up in a bounded cache; tests hold the ids against
    the tokenizers library's own. The strings of added tokens in a text become their ids, as the
    library's encode() has it; without added_tokens they are ordinary text.
    """

    def __init__(self, path: str, cached: int = 300_000, added_tokens: bool = True):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        vocabulary, special = saved["model"]["vocab"], {x["content"] for x in saved["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {x["content"]: x["id"].to_bytes(4, "little") for x in saved["added_tokens"]} if added_tokens else {}
        if any(x[k] for x in saved["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and added_tokens:
            raise ValueError("added tokens that take in or depend on what surrounds them are not supported")
        # Of two that begin at one place the longest is meant.
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces, self.strange = re.compile(_FAST).findall, re.compile("[^\x00-ſ]").search
        one, most = self.encoding._core_bpe.encode_single_piece, cached

        class Cache(dict):
            def __missing__(self, piece):
                found = b"".join([i.to_bytes(4, "little") for i in one(piece.encode())])
                if len(piece) <= 32:
                    if len(self) >= most:
                        self.clear()
                    self[piece] = found
                return found

        self.find = Cache().__getitem__

    def __call__(self, text: str) -> bytes:
        if self.apart and len(parts := self.apart.split(text)) > 1:
            return b"".join([self.added[x] if k % 2 else self.ordinary(x) for k, x in enumerate(parts)])
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if self.strange(text):
            import numpy as np

            return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        return b"".join(map(self.find, self.pieces(text)))


def lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """The pieces of n ids, longest first."""
    out, rest = [max_len] * (n // max_len), n % max_len
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, max_len: int = MAX_LEN, tokenizer: str | None = None, with_ids: bool = False, added_tokens: bool = True) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, bucket,
    and sequence_id and offset of its place; with_ids adds the ids themselves as an array.

    max_len is a power of two. A null text is empty: its document is the end id alone. Rows that
    repeat an id are packed each on their own. An empty table gives no pieces; other columns are not
    read. The tokenizer's file must be at the same path on each executor. added_tokens: see Ids.
    """
    if max_len & max_len - 1 or max_len < 1:
        raise ValueError("max_len must be a power of two")
    path = tokenizer or default_tokenizer()
    bound_batches(docs.sparkSession)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        to_ids, end = Ids(path, added_tokens=added_tokens), END_ID.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
        for batch in batches:
            out: tuple = ([], [], [], [], [], [])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = to_ids(text or "") + end
                n, at = len(raw) // 4, 0
                for size in lengths(n, max_len):
                    piece = raw[4 * at : 4 * (at + size)]
                    for column, x in zip(out, (doc_id, at, size, zlib.crc32(piece), n, piece), strict=True):
                        column.append(x)
                    at += size
            columns = [pa.array(x, pa.int64()) for x in out[:5]]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
