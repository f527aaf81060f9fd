"""Chunkers: texts into overlapping windows of words, pages, or sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


@dataclass(frozen=True)
class ChunkSizes:
    """Words: of a chunk at most, shared by neighbours, and of a chunk after the first at least."""

    most: int = 500
    overlap: int = 75
    least: int = 100


# The presets.
SMALL, STANDARD, LARGE = ChunkSizes(300, 50, 50), ChunkSizes(500, 75, 100), ChunkSizes(800, 100, 150)


def chunk_words(docs: DataFrame, sizes: ChunkSizes = STANDARD, keep_tail: bool = False) -> DataFrame:
    """id, chunk_id, chunk_index, start_word, end_word, content of docs (id, text).

    Starts advance by a fixed stride. A window that is not the text's end is cut after the last word of its
    final 50 (or the one after) that ends a sentence. A later window of fewer than the least words is left out
    unless keep_tail is set. All in columns: no window depends on another.
    """
    stride = sizes.most - sizes.overlap
    d = docs.select("id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))

    def size(i, w):
        """Of window i, whose words and the one after are w."""
        cap = F.least(F.lit(sizes.most), F.col("n") - i * stride)
        stops = F.filter(F.sequence(F.greatest(F.lit(0), cap - 50) + 1, cap), lambda j: F.get(w, j).rlike(r"[.!?;]\z"))
        return F.when(cap < F.col("n") - i * stride, F.coalesce(F.array_max(stops) + 1, cap)).otherwise(cap)

    def window(i):
        # A row is as long as a window, not as its text; the array of one binds the window's words.
        own = F.array(F.slice("w", i * stride + 1, F.lit(sizes.most + 1)))
        return F.get(F.transform(own, lambda w: F.struct(i.alias("i"), w.alias("w"), size(i, w).alias("size"))), F.lit(0))

    windows = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {stride} as int)")), window))
    d = d.select("id", F.explode(windows).alias("x")).select("id", F.col("x.i").alias("chunk_index"), "x.w", "x.size", (F.col("x.i") * stride).alias("start_word"))
    if not keep_tail:
        d = d.where((F.col("chunk_index") == 0) | (F.col("size") >= sizes.least))
    content = F.array_join(F.slice("w", F.lit(1), F.col("size")), " ")
    return d.select("id", F.concat_ws("-", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "start_word", (F.col("start_word") + F.col("size")).alias("end_word"), content.alias("content"))


def _cut_pages(pages: list[tuple[int, str]], sizes: ChunkSizes):
    """One document's (page_number, text) in order; yields (index, page_number, content)."""
    words, on = [], []
    for number, text in pages:
        found = text.split()
        words += found
        on += [number] * len(found)
    start, size, page, index = 0, sizes.most, 1, 0
    while start + size <= len(words):
        window = " ".join(words[start : start + size])
        at = max(window.rfind(x) for x in (". ", "! ", "? "))
        if at > len(window) / 2:
            window = window[: at + 1]
        taken = len(window.split())
        if taken >= sizes.least:
            yield index, page, window
            index += 1
        page = on[start + size - 1]
        # The next window has the overlap, what the cut left, and at least one word more.
        step = max(0, taken - sizes.overlap)
        start, size = start + step, max(sizes.most, size - step + 1)
    if len(words) - start >= max(1, sizes.least):
        yield index, page, " ".join(words[start:])


def chunk_pages(pages: DataFrame, sizes: ChunkSizes = STANDARD) -> DataFrame:
    """id, chunk_index, page_number, content of pages (id, page_number, text).

    A buffer runs over a document's pages and is cut where it is full, at the last sentence end beyond its
    half; what a cut leaves, and an overlap, open the next chunk. Chunks of fewer than the least words are left out.
    A chunk bears the page at which the cut before it fell, the first chunk page 1. Documents go through one at a time.
    """

    def cut(key, table):
        import pyarrow as pa

        rows = sorted((n or 0, t or "") for n, t in zip(table["page_number"].to_pylist(), table["text"].to_pylist(), strict=True))
        found = list(_cut_pages(rows, sizes))
        return pa.table([pa.array([key[0].as_py()] * len(found), table["id"].type), *[pa.array([f[j] for f in found], t) for j, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.string()))]], names=["id", "chunk_index", "page_number", "content"])

    kind = dict(pages.dtypes)["id"]
    return pages.select("id", F.col("page_number").cast("int").alias("page_number"), "text").groupBy("id").applyInArrow(cut, f"id {kind}, chunk_index int, page_number int, content string")


SECTION, SECTION_OVERLAP, LOOK_BACK = 2000, 200, 200


def _windows(text: str, most: int, overlap: int):
    """(start, end) of windows of most characters, each cut after the last paragraph or sentence end near its end."""
    start = 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            near = text[max(start, end - LOOK_BACK) : end]
            at = max((near.rfind(x) for x in ("\n\n", ". ", "! ", "? ", ".\n")), default=-1)
            if at > 0:
                end = max(start, end - LOOK_BACK) + at + 1
        yield start, end
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def chunk_sections(notes: DataFrame, most: int = SECTION, overlap: int = SECTION_OVERLAP) -> DataFrame:
    """id, chunk_index, section_title, start_position, end_position, content of notes (id, body).

    A note is split at its headings; what stands before the first is a section too. Sections over most
    characters are cut into windows. Contents are trimmed, positions are not; empty contents are left out.
    """

    def cut(batches):
        import re

        import pyarrow as pa

        heading = re.compile(r"^#{1,6}\s+(.+)$", re.M)
        for batch in batches:
            out: tuple = ([], [], [], [], [], [])
            for i, body in zip(batch["id"].to_pylist(), batch["body"].to_pylist(), strict=True):
                body = body or ""
                marks = [(0, None), *[(m.start(), m[1].strip()) for m in heading.finditer(body)], (len(body), None)]
                index = 0
                for (a, title), (b, _) in zip(marks, marks[1:]):
                    for s, e in _windows(body[a:b], most, overlap) if b > a else ():
                        if content := body[a + s : a + e].strip():
                            for column, x in zip(out, (i, index, title, a + s, a + e, content), strict=True):
                                column.append(x)
                            index += 1
            kinds = [batch["id"].type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["id", "chunk_index", "section_title", "start_position", "end_position", "content"])

    kind = dict(notes.dtypes)["id"]
    return notes.select("id", "body").mapInArrow(cut, f"id {kind}, chunk_index int, section_title string, start_position int, end_position int, content string")


def split_for_model(texts: DataFrame, most: int = 2000) -> DataFrame:
    """id, part, content of texts (id, text): parts of at most most characters for a model with bounded input."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, k, t[s:e]) for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True) if t for k, (s, e) in enumerate(_windows(t, most, 0))]
            kinds = [batch["id"].type, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["id", "part", "content"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(cut, f"id {kind}, part int, content string")
