"""Notes in Markdown: front matter, titles, links, tags and headings as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import nested
from ..functions.text import FRONT_MATTER, trimmed


def front_text(note: Column) -> Column:
    return F.regexp_extract(note, FRONT_MATTER, 1)


def body(note: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(note, FRONT_MATTER, ""), r"\A\s+", "")


def front_matter(note: Column) -> Column:
    """key to value of the flat lines 'key: value' and of lists below a key, joined by commas; quotes fall away."""
    # List entries are folded into their key's line first.
    flat = F.regexp_replace(front_text(note), r"\r?\n[ \t]*-[ \t]+", ", ")
    lines = F.filter(F.split(flat, r"\r?\n"), lambda l: l.rlike(r"^[A-Za-z0-9_-]+[ \t]*:"))
    clean = lambda v: F.regexp_replace(trimmed(F.regexp_replace(v, r"\A\s*,\s*", "")), r"""\A["'](.*)["']\z""", "$1")
    entry = lambda l: F.struct(F.regexp_extract(l, r"^([A-Za-z0-9_-]+)", 1).alias("key"), clean(F.regexp_extract(l, r"^[^:]*:(.*)$", 1)).alias("value"))
    return F.map_from_entries(_last_by_key(F.transform(lines, entry)))


def front(note: Column) -> Column:
    """The whole front matter with nested maps and lists, as a variant; an empty object where it is invalid."""
    return nested(front_text(note))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_by(values: Column, key) -> Column:
    """Of an array the first value of each key, in the array's order. Sorted by key, so that long arrays stay cheap."""
    placed = F.array_sort(F.transform(values, lambda v, i: F.struct(key(v).alias("key"), i.alias("i"), v.alias("v"))))
    first = lambda s: F.filter(F.transform(s, lambda x, j: F.when((j == 0) | ~x["key"].eqNullSafe(F.get(s, j - 1)["key"]), F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x.isNotNull())
    return F.transform(F.array_sort(_bound(placed, first)), lambda x: x["v"])


def _last_by_key(entries: Column) -> Column:
    """Of an array of (key, value) the last of each key."""
    return _first_by(F.reverse(entries), lambda e: e["key"])


def front_tags(front: Column) -> Column:
    """Tags of a map's entry, whether listed or in a line; one leading # falls away."""
    raw = F.regexp_replace(F.coalesce(F.try_element_at(front, F.lit("tags")), F.lit("")), r"[\[\]\"']", "")
    return F.filter(F.transform(F.split(raw, r"[,\s]+"), lambda t: F.regexp_replace(t, "^#", "")), lambda t: t != "")


def inline_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([A-Za-z0-9_/-]+)"), F.lit(1))


def tags(note: Column) -> Column:
    """Front matter's and then inline tags, each once whatever its case, in its first spelling."""
    every = F.concat(front_tags(front_matter(note)), inline_tags(body(note)))
    return _first_by(every, F.lower)


def title(note: Column, path: Column) -> Column:
    """Front matter's title, else the first heading of level one, else the file's name."""
    given = F.nullif(F.try_element_at(front_matter(note), F.lit("title")), F.lit(""))
    heading = F.nullif(trimmed(F.regexp_extract(body(note), r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return F.coalesce(given, heading, F.regexp_replace(F.regexp_extract(path, r"([^/]+)\z", 1), r"\.md\z", ""))


def _placed(text: Column, pattern: str, make) -> Column:
    """make(match, start, end) for each match of pattern, with its place in characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What lies before each match, from the pieces between matches.
    gaps = F.transform(F.split(text, pattern), F.length)
    add = lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array((a["at"] + x["gap"]).cast("int"))).alias("out"))
    starts = F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]
    return F.zip_with(found, starts, lambda m, s: make(m, s, s + F.length(m)))


def wikilinks(text: Column) -> Column:
    """target, heading, display, start and end (in characters) of each [[target#heading|display]]; those with neither target nor heading are left out."""

    def link(m, start, end):
        x = F.regexp_extract(m, r"\A\[\[([\s\S]+)\]\]\z", 1)
        place = F.get(F.split(x, r"\|", 2), 0)
        parts = F.split(place, "#", 2)
        none = lambda c: F.nullif(trimmed(c), F.lit(""))
        return F.struct(trimmed(F.get(parts, 0)).alias("target"), none(F.get(parts, 1)).alias("heading"), none(F.get(F.split(x, r"\|", 2), 1)).alias("display"), start.alias("start"), end.alias("end"))

    return F.filter(_placed(text, r"\[\[[^\]]+\]\]", link), lambda x: (x["target"] != "") | x["heading"].isNotNull())


def headings(text: Column) -> Column:
    """level, text and start (in characters) of each heading."""
    one = lambda m, start, end: F.struct(F.length(F.regexp_extract(m, "^(#+)", 1)).alias("level"), trimmed(F.regexp_replace(m, r"^#+\s+", "")).alias("text"), start.alias("start"))
    return _placed(text, r"(?m)^#{1,6}\s+.+$", one)


def parse(notes: DataFrame) -> DataFrame:
    """notes (relative_path, body) with id, title, frontmatter (flat entries), front (all of it, a variant), tags, wikilinks,
    headings, text, file_hash."""
    n = F.col("body")
    text = body(n)
    return notes.select(F.md5(F.col("relative_path").cast("binary")).alias("id"), "relative_path", title(n, F.col("relative_path")).alias("title"), front_matter(n).alias("frontmatter"), front(n).alias("front"), tags(n).alias("tags"), wikilinks(text).alias("wikilinks"), headings(text).alias("headings"), text.alias("text"), F.sha2(n.cast("binary"), 256).alias("file_hash"))


def backlinks(parsed: DataFrame) -> DataFrame:
    """id and source of links that name a note by its path without .md, its title, or the end of its path; own links aside."""
    l = parsed.select(F.col("id").alias("source"), F.explode("wikilinks").alias("l")).select("source", F.col("l.target").alias("target")).where("target <> ''").distinct()
    bare = F.regexp_replace("relative_path", r"\.md\z", "")
    ways = [(bare, F.col("target")), (F.col("title"), F.col("target")), (F.regexp_extract(bare, r"([^/]+)\z", 1), F.when(F.col("target").contains("/"), F.regexp_extract("target", r"([^/]+)\z", 1)))]
    found = None
    for name, of_link in ways:
        hit = parsed.select("id", name.alias("_name")).join(l.select("source", of_link.alias("_name")), "_name").select("id", "source")
        found = hit if found is None else found.union(hit)
    return found.where("id <> source").distinct()
