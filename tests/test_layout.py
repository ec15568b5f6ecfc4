"""Blocks and chunks: places in the source, and plain versions over all pages."""

import hashlib
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from weftgraph.operators import layout
from weftgraph.plans.registry import CATALOG

SF = "/root/testdata/sf0.001"
MARKDOWN = """# One
first line
second line

- a
- b
  more of b
1. c

| x | y |
|---|---|
| 1 | 2 |
## Two
```python
# not a heading

| not | a table |
```
after
### Three
#### Four
end
# Five
~~~
open fence"""


def test_markdown_blocks():
    got = [(k, n, MARKDOWN[a:b]) for k, n, a, b in layout.markdown_blocks(MARKDOWN)]
    assert [(k, n) for k, n, _ in got] == [("heading", 1), ("paragraph", 0), ("list", 0), ("table", 0), ("heading", 2), ("code", 0), ("paragraph", 0), ("heading", 3), ("heading", 4), ("paragraph", 0), ("heading", 1), ("code", 0)]
    assert got[1][2] == "first line\nsecond line" and got[2][2] == "- a\n- b\n  more of b\n1. c" and got[5][2].startswith("```python") and got[5][2].endswith("```")
    for text in ("", "\n\n", "   "):
        assert layout.markdown_blocks(text) == []
    assert [b[0] for b in layout.markdown_blocks("```\nnever closed\n")] == ["code"]


def test_html_blocks():
    page = "<!DOCTYPE html><head><title>no</title></head><body>loose <b>text</b><H2 class=x>Head</H2><p>one<p>two<script>var t='<p>x</p>'</script></p><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><td>1</td></tr></table><pre>x <b>y</b></pre><p> </p>tail"
    got = [(k, n, re.sub(r"<[^>]*>", "", layout.HIDDEN.sub(" ", page[a:b])).strip()) for k, n, a, b in layout.html_blocks(page)]
    assert [g[:2] for g in got] == [("paragraph", 0), ("heading", 2), ("paragraph", 0), ("paragraph", 0), ("list", 0), ("table", 0), ("code", 0), ("paragraph", 0)]
    assert [g[2] for g in got][:3] == ["loose text", "Head", "one"] and got[4][2] == "ab" and got[-1][2] == "tail"
    assert layout.html_blocks("<p></p>  <br>") == []


def test_heading_paths(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "id int, text string")
    found = layout.blocks(docs, "id", "text", "markdown").withColumn("said", layout.shown(F.col("source"), "markdown"))
    rows = layout.sections(found, "id").orderBy("n").collect()
    assert {r.id for r in rows} == {1}
    assert [(r.section, list(r.path)) for r in rows if r.kind == "paragraph"] == [(1, ["# One"]), (2, ["# One", "## Two"]), (4, ["# One", "## Two", "### Three", "#### Four"])]
    assert all(MARKDOWN[r.start : r.end] == r.source for r in rows)
    assert layout.blocks(docs.limit(0), "id", "text", "markdown").count() == 0


def plain_blocks(html):
    return [(n, k, level, a, b, re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", layout.HIDDEN.sub(" ", html[a:b]))).strip()) for n, (k, level, a, b) in enumerate(layout.html_blocks(html))]


def test_parent_child_of_all_pages(spark):
    want = set()
    for r in pd.read_parquet(f"{SF}/pages.parquet").to_dict("records"):
        groups, section = defaultdict(list), 0
        for b in plain_blocks(r["html"]):
            section += b[1] == "heading"
            if section and b[1] in ("heading", "paragraph"):
                groups[section].append(b)
        for s, some in groups.items():
            text = "\n\n".join(b[5] for b in some)
            if len(text) > 50:
                want.add((r["page_id"], s, "parent", some[0][0], min(b[3] for b in some), max(b[4] for b in some), some[0][5], len(text)))
                want |= {(r["page_id"], s, "child", b[0], b[3], b[4], some[0][5], len(b[5])) for b in some if b[1] == "paragraph" and len(b[5]) > 100}
    got = CATALOG["chunk_parent_child"].run(spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_layout_aware_chunks_of_all_pages(spark):
    want = set()
    for r in pd.read_parquet(f"{SF}/pages.parquet").to_dict("records"):
        chunks, part = [], None
        for n, kind, _, a, b, _ in plain_blocks(r["html"]):
            if kind in ("table", "code", "list"):
                chunks.append([kind, a, b, 1])
                part, filled = None, 0
            else:
                if part is None:
                    filled = 0
                if part is not None and filled // 800 == part:
                    chunks[-1][2:] = [b, chunks[-1][3] + 1]
                else:
                    chunks.append(["text", a, b, 1])
                    part = filled // 800
                filled += b - a
        want |= {(r["page_id"], n, k, a, b, c, hashlib.sha256(r["html"][a:b].encode()).hexdigest()) for n, (k, a, b, c) in enumerate(chunks)}
    got = {tuple(r) for r in CATALOG["chunk_layout_aware"].run(spark, SF).collect()}
    assert got == want and any(g[2] == "list" for g in got)


def test_context_of_tables(spark):
    docs = spark.createDataFrame([(1, "before " * 5 + "\n\n| a | b |\n| 1 | 2 |\n\nafter it all")], "id int, text string")
    chunks = layout.kept_whole(layout.blocks(docs, "id", "text", "markdown"), "id", 100)
    rows = layout.with_context(chunks, docs, "id", "text", 9, 7).orderBy("chunk").collect()
    assert [(r.kind, r.before, r.after) for r in rows] == [("text", None, None), ("table", "before \n\n", "\n\nafter"), ("text", None, None)]
    assert rows[1].text == "| a | b |\n| 1 | 2 |"
