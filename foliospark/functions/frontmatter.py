"""Front matter with nested entries: maps and lists by indentation, flow collections, quoted and block texts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{}"',#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)""")
_INT, _FLOAT = re.compile(r"[-+]?[0-9]+\Z"), re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))(?:[eE][-+]?[0-9]+)?\Z")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}
#: What stands for truth and for nothing.
_WORDS = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False, "null": None, "Null": None, "NULL": None, "~": None, "": None}
#: Deeper nesting counts as invalid.
DEEP = 64


class Invalid(ValueError):
    pass


def _scalar(text: str):
    text = text.strip()
    if text in _WORDS:
        return _WORDS[text]
    if text[0] == '"':
        if len(text) < 2 or not re.fullmatch(r'"(?:[^"\\]|\\.)*"', text, re.S):
            raise Invalid(text)
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
    if text[0] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
            raise Invalid(text)
        return text[1:-1].replace("''", "'")
    if text[0] in "&*!%@`" or re.search(r":\s", text):
        raise Invalid(text)
    if _INT.match(text):
        return int(text)
    return float(text) if _FLOAT.match(text) else text


def _uncommented(text: str) -> str:
    """A line's rest without a comment behind it; what stands in quotes is left."""
    if "#" not in text:
        return text.rstrip()
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'" and (i == 0 or text[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


class _Flow:
    """[a, b] and {a: b}."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def value(self, deep: int = 0):
        self.blank()
        if deep > DEEP or self.at >= len(self.text):
            raise Invalid(self.text)
        c = self.text[self.at]
        if c in "[{":
            self.at += 1
            out: list | dict = [] if c == "[" else {}
            while True:
                self.blank()
                if self.take("]" if c == "[" else "}"):
                    return out
                if c == "[":
                    out.append(self.value(deep + 1))
                else:
                    key = self.plain(",:}")
                    out[str(key)] = self.value(deep + 1) if self.take(":") else None
                self.blank()
                if not self.take(",") and self.text[self.at : self.at + 1] not in tuple("]}"):
                    raise Invalid(self.text)
        return self.plain(",]}")

    def plain(self, ends: str):
        m = re.compile(r"\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')\s*").match(self.text, self.at)
        if not m:
            m = re.compile(rf"((?:[^{re.escape(ends)}:]|:(?!\s){'' if ':' not in ends else '(?=$^)'})*)").match(self.text, self.at)
        self.at = m.end()
        return _scalar(m[1]) if m[1].strip() else None

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, c: str) -> bool:
        self.blank()
        if self.text[self.at : self.at + 1] == c:
            self.at += 1
            return True
        return False


class _Lines:
    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that isn't blank or a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.lstrip(" ")
            if bare.strip() and not bare.startswith("#"):
                if bare[0] == "\t":
                    raise Invalid("a tab indents")
                return len(line) - len(bare), bare
            self.at += 1
        return None

    def block(self, indent: int, deep: int = 0):
        """The map or list whose lines stand at indent."""
        if deep > DEEP:
            raise Invalid("too deep")
        out: list | dict | None = None
        while (found := self.peek()) and found[0] >= indent:
            here, text = found
            if here != indent:
                raise Invalid(text)
            listed = text == "-" or text.startswith("- ")
            if out is None:
                out = [] if listed else {}
            if listed != isinstance(out, list):
                if listed or deep == 0:
                    raise Invalid(text)
                break
            if listed:
                rest = text[1:].lstrip(" ")
                inner = indent + len(text) - len(rest)
                if rest and not rest.startswith("#") and (_KEY.match(rest) or rest.startswith("- ")) and rest[0] not in "[{":
                    # The entry's own first line counts as a line of its map or list.
                    self.lines[self.at] = " " * inner + rest
                    out.append(self.block(inner, deep + 1))
                else:
                    self.at += 1
                    out.append(self.after(rest, indent, deep, inside_list=True))
            else:
                m = _KEY.match(text)
                if not m:
                    raise Invalid(text)
                key = str(_scalar(m[1])) if m[1][0] in "\"'" else m[1]
                if key in out:
                    raise Invalid(f"{key} twice")
                self.at += 1
                out[key] = self.after(text[m.end() :], indent, deep)
        return out

    def after(self, rest: str, indent: int, deep: int, inside_list: bool = False):
        """What follows a key or a dash."""
        rest = _uncommented(rest)
        if re.fullmatch(r"[|>][-+0-9]*", rest):
            return self.text_block(rest, indent)
        if rest:
            if rest[0] in "[{":
                while rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and (more := self.peek()) and more[0] > indent:
                    rest += " " + _uncommented(more[1])
                    self.at += 1
                flow = _Flow(rest)
                value = flow.value()
                if rest[flow.at :].strip():
                    raise Invalid(rest)
                return value
            # A plain text goes on in deeper lines.
            while (more := self.peek()) and more[0] > indent and rest[0] not in "\"'":
                if _KEY.match(more[1]):
                    raise Invalid(more[1])
                rest += " " + _uncommented(more[1])
                self.at += 1
            return _scalar(rest)
        found = self.peek()
        if found and (found[0] > indent or (found[0] == indent and not inside_list and (found[1] == "-" or found[1].startswith("- ")))):
            listed = found[1] == "-" or found[1].startswith("- ")
            if not listed and not _KEY.match(found[1]):
                self.at += 1
                return self.after(found[1], indent, deep + 1)
            return self.block(found[0], deep + 1)
        return None

    def text_block(self, mark: str, indent: int) -> str:
        kept: list[str] = []
        width = None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                here = len(line) - len(line.lstrip(" "))
                if here <= indent:
                    break
                width = here if width is None else width
                kept.append(line[min(width, here) :])
            else:
                kept.append("")
            self.at += 1
        body = "\n".join(kept).rstrip("\n")
        if mark[0] == ">":
            body = re.sub(r"(?<![\n ])\n(?![\n ])", " ", body)
            body = re.sub(r"\n\n", "\n", body)
        return body if "-" in mark or not body else body + "\n"


def parse(text: str) -> dict:
    """Front matter as nested values; what is invalid or no map is empty."""
    try:
        lines = _Lines(text)
        found = lines.peek()
        if not found:
            return {}
        if found[1][0] in "[{":
            value = _Flow("\n".join(lines.lines)).value()
        else:
            value = lines.block(found[0])
            if lines.peek():
                return {}
        return value if isinstance(value, dict) else {}
    except (Invalid, RecursionError):
        return {}


@F.pandas_udf(StringType())
def _as_json(text):
    return text.map(lambda t: json.dumps(parse(t or ""), ensure_ascii=False))


def nested(front: Column) -> Column:
    """A note's front matter (the text between its marks) as a variant: an object, empty where there is none or it is
    invalid. variant_get(.., '$.a.b[0]', 'string') reads from it."""
    return F.parse_json(_as_json(front))
