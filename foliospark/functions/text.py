"""Text functions as columns: tokens, names, slugs, snippets, HTML and Markdown to text, citations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it; Java's own classes differ.
WS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_WS = WS.replace("[", "[^", 1)

#: Runs of two or more characters that lexical search keeps: a-z, U+00E0 to U+00FF, digits and hyphens.
TERM = "[a-z\u00E0-\u00FF0-9-]{2,}"


def words(text: Column) -> Column:
    """Non-empty runs without white space."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Terms of lexical search. One pattern does what lower-casing, blanking and splitting do in steps."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def keywords(text: Column) -> Column:
    """Terms of over four characters, as they are looked for in contents."""
    return F.filter(terms(text), lambda t: F.length(t) > 4)


def exact_hit(content: Column, keys: Column) -> Column:
    """Whether any keyword is a substring of the lower-cased content."""
    low = F.lower(content)
    return F.exists(keys, lambda k: F.contains(low, k))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-cased tokens between white space; edge empties count, as splitting leaves them."""
    x, y = (F.array_distinct(F.split(F.lower(c), f"{WS}+")) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def decode_entities(text: Column) -> Column:
    """Six entities in a fixed order: &amp; first, so that doubly escaped ones are decoded twice."""
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_to_text(html: Column, drop_code: bool = True) -> Column:
    """Without scripts, styles and tags, entities decoded, white space collapsed and trimmed."""
    text = html
    if drop_code:
        for tag in ("script", "style"):
            text = F.regexp_replace(text, rf"(?i)<{tag}[^>]*>[\s\S]*?</{tag}>", "")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    return trimmed(F.regexp_replace(text, f"{WS}+", " "))


def html_title(html: Column) -> Column:
    """The title element's raw content, trimmed; null where there is none."""
    found = F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1)
    return F.nullif(trimmed(found), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


# The rewrites in their order, which is part of the meaning: inline code goes before
# fences, links before images.
_MARKDOWN = (
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"\*(.+?)\*", "$1"),
    (r"~~(.+?)~~", "$1"),
    (r"`(.+?)`", "$1"),
    (r"```[\s\S]*?```", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"(?m)^\s*>\s+", ""),
    (r"\n{3,}", "\n\n"),
)
FRONT_MATTER = r"\A---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)"


def markdown_to_text(text: Column) -> Column:
    text = F.regexp_replace(text, FRONT_MATTER, "")
    for pattern, to in _MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return trimmed(text)


#: Latin letters with marks and the letters that they decompose to, from the Unicode tables.
_ACCENTED = {chr(c): d for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))[0]) != chr(c) and d.isascii()}
_MARKS = r"[\u0300-\u036F]"


def fold(text: Column) -> Column:
    """Without accents."""
    return F.regexp_replace(F.translate(text, "".join(_ACCENTED), "".join(_ACCENTED.values())), _MARKS, "")


def normal_name(name: Column) -> Column:
    """Lower case, no accents, only a-z, digits, spaces and hyphens, spaces squeezed."""
    kept = F.regexp_replace(fold(F.lower(name)), rf"[^a-z0-9{WS[1:-1]}-]", "")
    return trimmed(F.regexp_replace(kept, f"{WS}+", " "))


def entity_id(kind: Column, name: Column) -> Column:
    return F.md5(F.concat(kind, F.lit(":"), normal_name(name)).cast("binary"))


#: Letters that slugs fold.
_SLUG_FROM, _SLUG_TO = "àáâãäåèéêëìíîïòóôõöùúûüç", "aaaaaaeeeeiiiiooooouuuuc"


def slug(text: Column, most: int = 50) -> Column:
    """Lower case, common accents folded, only a-z, digits and hyphens, white space as hyphens, cut to most, none at the end."""
    kept = F.regexp_replace(F.translate(F.lower(text), _SLUG_FROM, _SLUG_TO), rf"[^a-z0-9{WS[1:-1]}-]", "")
    return F.regexp_replace(F.substring(F.regexp_replace(kept, f"{WS}+", "-"), 1, most), r"-+\z", "")


def export_name(day: Column, text: Column) -> Column:
    """day-slug.md; a text without anything to keep is called export."""
    return F.concat(day, F.lit("-"), F.coalesce(F.nullif(slug(text), F.lit("")), F.lit("export")), F.lit(".md"))


def short_title(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def snippet(text: Column, most: int = 150) -> Column:
    """Without headings, links and emphasis; cut at most and back before the last white space, with dots."""
    plain = F.regexp_replace(text, r"(?m)^#{1,6}\s+.+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), r"\[\[([^\]|]+)\]\]", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), "[*_~`]+", "")
    plain = trimmed(F.regexp_replace(plain, r"\n{2,}", " "))
    cut = F.regexp_replace(F.substring(plain, 1, most), rf"{WS}{NOT_WS}*\z", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(cut, F.lit("...")))


def citation(author: Column, title: Column, year: Column, page: Column) -> Column:
    """author - title - (year) - p. page, without what is missing."""
    present = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.concat_ws(" - ", present(author), present(title), F.concat(F.lit("("), present(year), F.lit(")")), F.concat(F.lit("p. "), present(page)))


#: The six entity types and other names for them.
ENTITY_TYPES = {
    "PERSON": "PERSON",
    "LOCATION": "LOCATION",
    "DATE": "DATE",
    "ORGANIZATION": "ORGANIZATION",
    "EVENT": "EVENT",
    "CONCEPT": "CONCEPT",
    "PER": "PERSON",
    "PERSONNE": "PERSON",
    "LOC": "LOCATION",
    "LIEU": "LOCATION",
    "GPE": "LOCATION",
    "PLACE": "LOCATION",
    "ORG": "ORGANIZATION",
    "EVT": "EVENT",
    "ÉVÉNEMENT": "EVENT",
}


def entity_type(kind: Column) -> Column:
    """The canonical type; null for others, which are dropped."""
    table = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    return F.try_element_at(table, F.upper(trimmed(kind)))


def first_json_array(text: Column, schema: str) -> Column:
    """Of a model's answer: its first [ to its last ] as JSON, else its lines that are objects, else nothing."""
    whole = F.from_json(F.regexp_extract(text, r"(\[[\s\S]*\])", 1), f"array<{schema}>")
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\{.*\}")), lambda x: F.from_json(F.regexp_extract(x, r"(\{.*\})", 1), schema))
    return F.coalesce(whole, F.filter(lines, lambda x: x.isNotNull()))


def agent_step(text: Column) -> Column:
    """Of an agent's answer: thought, action, action_input and answer from its JSON, else by pattern, else all as the answer."""
    schema = "struct<thought:string,action:string,action_input:string,answer:string>"
    parsed = F.from_json(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), schema)
    by_pattern = lambda key: F.nullif(F.regexp_extract(text, rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    thought, answer = by_pattern("thought"), by_pattern("answer")
    usable = parsed.isNotNull() & (F.coalesce(parsed["thought"], parsed["action"], parsed["answer"]).isNotNull())
    found = F.struct(thought.alias("thought"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("action_input"), F.coalesce(answer, F.when(thought.isNull(), text)).alias("answer"))
    return F.when(usable, parsed).otherwise(found)


