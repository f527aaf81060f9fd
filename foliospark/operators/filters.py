"""Predicates on documents, notes and bibliography items. Needles are matched as plain text, letter case aside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def among(column: Column, values: list | None) -> Column:
    """Membership; an empty or missing list doesn't filter."""
    return column.isin(*values) if values else F.lit(True)


def has(text: Column, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(needle.lower()))


def author_is(author: Column, creators: Column | None, needle: str) -> Column:
    """By author, or by 'first last' of creators (array of first, last)."""
    hit = has(author, needle)
    if creators is not None:
        hit = hit | F.coalesce(F.exists(creators, lambda c: has(F.concat_ws(" ", c["first"], c["last"]), needle)), F.lit(False))
    return hit


def year_is(year: Column, needle: str) -> Column:
    return F.contains(F.coalesce(year.cast("string"), F.lit("")), F.lit(needle))


def tagged(tags: Column, wanted: list[str]) -> Column:
    """Any of wanted, one leading # aside."""
    low = [w.lower().removeprefix("#") for w in wanted]
    plain = F.transform(tags, lambda t: F.regexp_replace(F.lower(t), "^#", ""))
    return F.coalesce(F.arrays_overlap(plain, F.array(*map(F.lit, low))), F.lit(False)) if low else F.lit(True)


def any_has(values: Column, needle: str) -> Column:
    return F.coalesce(F.exists(values, lambda v: has(v, needle)), F.lit(False))


def text_has(columns: list[Column], needle: str) -> Column:
    return has(F.concat_ws(" ", *columns), needle)


def links_to(targets: Column, needle: str) -> Column:
    return any_has(targets, needle)


def front_matter_has(front: Column, key: str, value: str | None = None) -> Column:
    """A map's key is there and, where a value is asked for, contains it."""
    there = F.coalesce(F.map_contains_key(front, F.lit(key)), F.lit(False))
    return there & has(F.try_element_at(front, F.lit(key)), value) if value is not None else there


#: Extensions that can be read, and folders that are never scanned in a vault.
READABLE = ("txt", "md", "markdown", "html", "htm")
INGESTED = ("pdf", "txt", "md", "html", "htm")
IGNORED = (".obsidian", ".git", ".trash", "node_modules", ".DS_Store")


def readable(path: Column, extensions=READABLE) -> Column:
    """A supported extension, and no part of the path starts with a dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions) & ~path.rlike(r"(^|/)\.[^/]")
