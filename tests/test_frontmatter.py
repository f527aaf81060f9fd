import pytest
from pyspark.sql import functions as F

from foliospark.functions.frontmatter import DEEP, parse
from foliospark.operators import notes

NOTE = """---
title: "A: b"
n: 3
x: 1.5
ok: true
none:
tags: [a, "b, c", {k: v}]
# comment
author:
  name: Ann   # note
  roles:
    - editor
    - name: writer
      since: 1999
  address: {city: Paris, zip: "75001"}
list:
- one
- - n1
  - n2
text: |
  line one
    indented

  line two
folded: >-
  joined
  lines

  new
url: http://x.org/a#b
'single': 'it''s'
long: goes on
  in the next line
flow: [1,
  2]
---

Body
"""


def test_nested_values():
    got = parse(NOTE.split("---")[1])
    assert got == {
        "title": "A: b", "n": 3, "x": 1.5, "ok": True, "none": None, "tags": ["a", "b, c", {"k": "v"}],
        "author": {"name": "Ann", "roles": ["editor", {"name": "writer", "since": 1999}], "address": {"city": "Paris", "zip": "75001"}},
        "list": ["one", ["n1", "n2"]], "text": "line one\n  indented\n\nline two\n", "folded": "joined lines\nnew",
        "url": "http://x.org/a#b", "single": "it's", "long": "goes on in the next line", "flow": [1, 2],
    }


@pytest.mark.parametrize("bad", ["a: b: c", "- x\n- y", "a:\n\t- b", "a: [1, 2", "a: 1\na: 2", "just text", 'a: "x', "a:\n    b: 1\n  c: 2", "", "# only", "a: &b c", "\n".join(f"{' ' * k}k:" for k in range(DEEP + 9)), "a: " + "[" * 500])
def test_invalid_is_empty(bad):
    assert parse(bad) == {}


def test_as_variants(spark):
    rows = [(1, NOTE), (2, "no front matter"), (3, "---\na: [1, 2\n---\nx"), (4, None), (5, "---\r\na:\r\n  b: ü\r\n---\r\nx")]
    df = spark.createDataFrame([(i, f"{i}.md", t) for i, t in rows], "i int, relative_path string, body string")
    read = lambda path, kind="string": F.try_variant_get("front", path, kind)
    got = {r.i: r for r in notes.parse(df).join(df.select("i", "relative_path"), "relative_path").select("i", F.to_json("front").alias("j"), read("$.author.roles[1].since", "int").alias("since"), read("$.a.b").alias("b")).collect()}
    assert got[1].since == 1999 and got[5].b == "ü"
    assert got[2].j == got[3].j == "{}"
