"""Chunks of pages that keep their layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.operators import layout
from weftgraph.session import table

CATALOG = Catalog()
q = CATALOG.add


def said(spark, d):
    found = layout.blocks(table(spark, d, "pages"), "page_id", "html", "html")
    return found.withColumn("said", layout.shown(F.col("source"), "html"))


BODY = "SELECT page_id, regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>|<head.*?</head>', '', 'gs') AS h FROM pages"


COUNTS = " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, len(regexp_extract_all(h, '<{t}[^>]*>')) AS n FROM b" for k, t in (("heading", "h1"), ("list", "ul")))


@q("layout_blocks", f"WITH b AS ({BODY}) SELECT * FROM ({COUNTS}) WHERE n > 0", "C6 C7")
def layout_blocks(spark, d):
    """Headings and lists of each page, by its blocks."""
    return said(spark, d).filter("kind IN ('heading', 'list')").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@q("chunk_parent_child", None, "C6 C7")
def chunk_parent_child(spark, d):
    """Sections of pages as parents, their paragraphs as children, with places in the source."""
    return layout.parent_child(said(spark, d), "page_id").select("page_id", "section", "level", "n", "start", "end", "heading", F.length("text").alias("chars"))


@q("chunk_layout_aware", None, "C6 C7")
def chunk_layout_aware(spark, d):
    """Lists, tables and code of pages whole, the rest packed to 800 characters; the source of each chunk with its digest."""
    pages = table(spark, d, "pages")
    chunks = layout.kept_whole(said(spark, d), "page_id", 800)
    return layout.with_context(chunks, pages, "page_id", "html").select("page_id", "chunk", "kind", "start", "end", "blocks", F.sha2("text", 256).alias("digest"))
