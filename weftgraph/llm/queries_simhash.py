"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import simhash
from weftgraph.llm.shared import written

CATALOG = Catalog()


@CATALOG.add("op3_simhash_trie", covers="llm 3")
def op3_simhash_trie(spark, sf_dir):
    """Fingerprint and group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = written(simhash.with_fingerprint(docs).select("doc_id", "fingerprint"), "fingerprints")
    found = simhash.groups(marked)
    rows = marked.join(found, marked.fingerprint == found.fp)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
