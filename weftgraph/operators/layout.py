"""Blocks of laid-out texts, and chunks that keep them whole: headings with their sections, tables, code, lists.

A text (HTML or Markdown) becomes blocks (kind, level, start, end): places in the source, so that what a chunk shows can be
found there again. Blocks are found where the text is read; the chunkers are DataFrame operations on blocks.

Kinds: heading (level 1 to 6), paragraph, list, table, code. In HTML, script, style and head have no blocks, what is outside of
block elements is a paragraph, and an element that isn't closed ends where the next block begins. In Markdown, code is fenced,
lists and tables are runs of lines; other lines up to a blank one are a paragraph. A null or blank text has no blocks.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows and characters of an Arrow batch that are worked on together; a longer text is worked on alone.
ROWS, CHARACTERS = 2000, 8 << 20
HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>|<!doctype[^>]*>")
BLOCK = re.compile(r"(?is)<(?P<tag>h[1-6]|p|pre|table|ul|ol|dl)\b[^>]*>")
LINE = re.compile(r"[^\n]*\n?")
ITEM, ROW, HEAD = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+\S"), re.compile(r"\s*\|?[^|\n]+\|[^\n]*"), re.compile(r"(#{1,6})\s+\S")
KINDS = {"p": "paragraph", "pre": "code", "table": "table", "ul": "list", "ol": "list", "dl": "list"}
TAG = re.compile(r"<[^>]*>")
Block = tuple[str, int, int, int]


def html_blocks(text: str) -> list[Block]:
    """Blocks of a page. The inner part of an element is its text; its tags are left in the source."""
    hidden = [m.span() for m in HIDDEN.finditer(text)]
    shown = list(text)
    for a, b in hidden:
        shown[a:b] = " " * (b - a)
    page, out, at = "".join(shown), [], 0

    def loose(a: int, b: int) -> None:
        if TAG.sub(" ", page[a:b]).strip():
            some = page[a:b]
            out.append(("paragraph", 0, a + len(some) - len(some.lstrip()), a + len(some.rstrip())))

    while m := BLOCK.search(page, at):
        loose(at, m.start())
        tag = m["tag"].lower()
        close = re.compile(rf"(?i)</{tag}\s*>").search(page, m.end())
        end, at = (close.start(), close.end()) if close else (len(page), len(page))
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (following := BLOCK.search(page, m.end())) and following.start() < end:
            end = at = following.start()  # not closed
        elif tag in ("ul", "ol", "table", "dl"):
            depth, place = 1, m.end()
            for inner in re.compile(rf"(?i)<(/?){tag}\b[^>]*>").finditer(page, m.end()):
                depth += -1 if inner[1] else 1
                place = inner.start()
                if not depth:
                    end, at = place, inner.end()
                    break
        if TAG.sub(" ", page[m.end() : end]).strip():
            out.append(("heading", int(tag[1]), m.end(), end) if tag[0] == "h" else (KINDS[tag], 0, m.end(), end))
    loose(at, len(page))
    return out


def markdown_blocks(text: str) -> list[Block]:
    """Blocks of lines."""
    out: list[Block] = []
    kind, start, end, fence = None, 0, 0, None

    def close() -> None:
        nonlocal kind
        if kind:
            out.append((kind, 0, start, end))
        kind = None

    for m in LINE.finditer(text):
        line = m[0]
        if not line:
            break
        a, b = m.start(), m.start() + len(line.rstrip("\n"))
        mark = line.strip()[:3]
        if fence:
            end = b
            if mark == fence:
                fence = None
                close()
            continue
        if mark in ("```", "~~~"):
            close()
            kind, start, end, fence = "code", a, b, mark
        elif not line.strip():
            close()
        elif head := HEAD.match(line):
            close()
            out.append(("heading", len(head[1]), a, b))
        else:
            new = "list" if ITEM.match(line) else "table" if ROW.match(line) else "list" if kind == "list" and line[0] in " \t" else "paragraph"
            if new != kind:
                close()
                kind, start = new, a
            end = b
    close()
    return out


FORMATS = {"html": html_blocks, "markdown": markdown_blocks}
BLOCKS = "n long, kind string, level int, start long, end long"


def blocks(docs: DataFrame, id: str, text: str, form: str) -> DataFrame:
    """(id, n, kind, level, start, end, source): a row for each block, source its part of the text."""
    find, kind = FORMATS[form], docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for key, value in zip(batch.column(id).to_pylist(), batch.column(text).to_pylist(), strict=True):
                rows += [(key, n, *b, value[b[2] : b[3]]) for n, b in enumerate(find(value or ""))]
                held += len(value or "")
                if held >= CHARACTERS or len(rows) >= ROWS * 10:
                    yield out(rows, batch.schema.field(id).type)
                    rows, held = [], 0
            if rows:
                yield out(rows, batch.schema.field(id).type)

    def out(rows, key_type):
        kinds = [key_type, pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id, "n", "kind", "level", "start", "end", "source"])

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, {BLOCKS}, source string")


def shown(source: Column, form: str) -> Column:
    """What a block says: HTML without tags, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(source, HIDDEN.pattern, " "), r"<[^>]*>", " ") if form == "html" else source
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def sections(found: DataFrame, id: str) -> DataFrame:
    """Adds section (headings up to the block; 0 before the first), and path: the headings above, outermost first.

    Blocks are ordered within a text, so a text's blocks meet in one task; a text is bounded, a corpus isn't."""
    upto = W.partitionBy(id).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    out = found.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(upto).cast("long"))
    for level in range(1, 7):
        # the last heading of a level holds until one of that level or above comes
        out = out.withColumn(f"_at{level}", F.max(F.when((F.col("kind") == "heading") & (F.col("level") <= level), F.col("n"))).over(upto))
        out = out.withColumn(f"_h{level}", F.max(F.when((F.col("kind") == "heading") & (F.col("level") == level), F.struct("n", "said"))).over(upto))
    parts = [F.when(F.col(f"_h{k}.n") == F.col(f"_at{k}"), F.col(f"_h{k}.said")) for k in range(1, 7)]
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop(*[f"_{x}{k}" for x in ("at", "h") for k in range(1, 7)])


def parent_child(found: DataFrame, id: str, least_parent: int = 50, least_child: int = 100) -> DataFrame:
    """(id, section, level, start, end, heading, children, parent_n, text): a parent for each section with a heading, of its heading
    and paragraphs, and its paragraphs of more than least_child characters as children; parents of least_parent or less go.

    found: blocks with `said` (see `shown`); texts of a parent are joined by blank lines."""
    held = sections(found, id).filter((F.col("section") > 0) & F.col("kind").isin("heading", "paragraph"))
    parents = held.groupBy(id, "section").agg(
        F.min("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("n", "kind", "said"))).alias("b")
    )  # a section of one text
    parents = parents.select(id, "section", F.lit("parent").alias("level"), "n", "start", "end", F.col("b")[0]["said"].alias("heading"), F.array_join(F.col("b.said"), "\n\n").alias("text"))
    parents = parents.filter(F.length("text") > least_parent)
    children = held.filter((F.col("kind") == "paragraph") & (F.length("said") > least_child)).select(id, "section", F.lit("child").alias("level"), "n", "start", "end", F.col("said").alias("text"))
    children = children.join(parents.select(id, "section", "heading"), [id, "section"])
    return parents.unionByName(children.select(id, "section", "level", "n", "start", "end", "heading", "text"))


def kept_whole(found: DataFrame, id: str, size: int, kinds: tuple[str, ...] = ("table", "code", "list")) -> DataFrame:
    """(id, chunk, kind, start, end, blocks): tables, code and lists as chunks of their own, and the blocks between them packed, in
    order, into chunks that begin anew once `size` characters of source have been filled.

    The filling is counted from the last block that is kept whole, so each chunk follows from sums within a text."""
    order = W.partitionBy(id).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    whole = F.col("kind").isin(*kinds)
    out = found.withColumn("run", F.sum(whole.cast("int")).over(order))
    before = W.partitionBy(id, "run", "whole").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("whole", whole).withColumn("filled", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)))
    part = F.when(F.col("whole"), F.lit(-1)).otherwise(F.floor(F.col("filled") / size))
    out = out.groupBy(id, "run", part.alias("part")).agg(F.min("n").alias("n"), F.first("kind").alias("_k"), F.max("whole").alias("whole"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("blocks"))
    place = W.partitionBy(id).orderBy("n")
    return out.select(id, (F.row_number().over(place) - 1).alias("chunk"), F.when(F.col("whole"), F.col("_k")).otherwise("text").alias("kind"), "start", "end", "blocks")


def with_context(chunks: DataFrame, docs: DataFrame, id: str, text: str, before: int = 200, after: int = 200, kinds: tuple[str, ...] = ("table",)) -> DataFrame:
    """Adds the text of each chunk; chunks of the kinds also have so many characters before and after them as context."""
    rows = chunks.join(docs.select(id, F.col(text).alias("_t")), id)
    wide = F.col("kind").isin(*kinds)
    piece = lambda a, b: F.substring(F.col("_t"), a + 1, b - a)
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    begin = F.greatest(F.lit(0), start - before)
    return rows.withColumns({"text": piece(start, end), "before": F.when(wide, piece(begin, start)), "after": F.when(wide, F.substring(F.col("_t"), end + 1, F.lit(after)))}).drop("_t")
