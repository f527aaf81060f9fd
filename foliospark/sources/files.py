"""Text files: scans of folders and vaults, and extraction of plain text by extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_title, html_to_text, markdown_to_text
from ..operators.filters import IGNORED, INGESTED, readable


def scan(spark: SparkSession, folder: str, recursive: bool = True, extensions=INGESTED) -> DataFrame:
    """path, modified, size, content of the readable files in folder; names with a leading dot are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(readable(F.regexp_extract("path", r"([^/]+)\z", 1), extensions)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def scan_vault(spark: SparkSession, folder: str, ignored: list[str] | None = None) -> DataFrame:
    """relative_path, modified, size, body of the notes (.md) in a vault.

    Folders of the ignore list and those with a leading dot are skipped, and what matches ignored, as a name or
    as a pattern.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    top = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.regexp_replace("path", rf"\A.*?\Q{top}\E/", "")
    out = files.select(relative.alias("relative_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").cast("string").alias("body"))
    parts = F.split("relative_path", "/")
    bad = F.exists(parts, lambda p: p.isin(*IGNORED) | F.startswith(p, F.lit(".")))
    for pattern in ignored or []:
        bad = bad | F.array_contains(parts, pattern) | F.col("relative_path").rlike(pattern)
    return out.where(~bad)


def read_note(spark: SparkSession, folder: str, relative_path: str) -> DataFrame:
    """relative_path, body of one note of a vault."""
    read = spark.read.text(f"{folder.rstrip('/')}/{relative_path}", wholetext=True)
    return read.select(F.lit(relative_path).alias("relative_path"), F.col("value").alias("body"))


def extract_pages(files: DataFrame, reader: Callable) -> tuple[DataFrame, DataFrame]:
    """documents (path, title, author, and other fields, page_count, text, file_hash) and pages (path, page_number, text)
    of PDF files (path, content).

    reader is a function from a column of bytes to structs of pages, an array of (number, items), and info, a struct
    of text fields; title is the file's name where info has none. Pages are rows for chunk_pages.
    """
    pdf = files.where(F.lower("path").endswith(".pdf")).select("path", F.sha2("content", 256).alias("file_hash"), reader(F.col("content")).alias("r"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\z", 1), r"\.[^.]+\z", "")
    info = [c for c in pdf.select("r.info.*").columns if c != "title"]
    given = F.nullif(F.trim("r.info.title"), F.lit("")) if "title" in pdf.select("r.info.*").columns else F.lit(None).cast("string")
    documents = pdf.select("path", F.coalesce(given, stem).alias("title"), *[F.col(f"r.info.{c}") for c in info], F.size("r.pages").alias("page_count"), pages_to_text(F.col("r.pages")).alias("text"), "file_hash")
    pages = pdf.select("path", F.explode("r.pages").alias("p")).select("path", F.col("p.number").alias("page_number"), page_text(F.col("p")).alias("text"))
    return documents, pages


def extract(files: DataFrame, pdf: Callable | None = None) -> DataFrame:
    """path, format, title, text, status of files (path, content).

    Texts are UTF-8; Markdown and HTML lose their markup. pdf is a function from a column of bytes to a
    column of texts, where one is at hand. What can't be read has status 'unsupported' and no text.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    raw = F.col("content").cast("string")
    kind = F.when(ext.isin("md", "markdown"), "md").when(ext.isin("html", "htm"), "html").when(ext == "txt", "txt").when(ext == "pdf", "pdf")
    text = F.when(kind == "md", markdown_to_text(raw)).when(kind == "html", html_to_text(raw)).when(kind == "txt", raw)
    if pdf is not None:
        text = text.when(kind == "pdf", pdf(F.col("content")))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\z", 1), r"\.[^.]+\z", "")
    out = files.select("path", kind.alias("format"), F.coalesce(F.when(kind == "html", html_title(raw)), stem).alias("title"), text.alias("text"), F.sha2("content", 256).alias("file_hash"))
    return out.withColumn("status", F.when(F.col("text").isNull(), "unsupported").otherwise("ok"))


def page_text(page):
    """A page's (items: texts) text, collapsed."""
    return F.trim(F.regexp_replace(F.array_join(page["items"], " "), r"\s+", " "))


def pages_to_text(pages):
    """Of an array of pages (number, items): the pages' texts, with blank lines between."""
    return F.array_join(F.transform(pages, page_text), "\n\n")
