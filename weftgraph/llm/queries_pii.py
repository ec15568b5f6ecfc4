"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import pii

CATALOG = Catalog()
#: A deployment passes its own secret; this one only makes the query repeatable.
KEY = b"weftgraph: key for tests and benches"


@CATALOG.add("op4_feistel_pseudonyms", covers="llm 4")
def op4_feistel_pseudonyms(spark, sf_dir):
    """Every whole document with pseudonyms, and how many values of which kinds it held."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    masked = pii.pseudonymised(docs, KEY)
    kinds = F.array_join(F.sort_array(F.array_distinct(F.transform("pii_spans", lambda s: s["kind"]))), ",")
    return masked.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_pii"), kinds.alias("kinds"))
