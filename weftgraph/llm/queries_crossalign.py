"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import crossalign

CATALOG = Catalog()


@CATALOG.add("op11_segment_alignment", covers="llm 11")
def op11_segment_alignment(spark, sf_dir):
    """Alignment of two vocabularies' tokens in every whole text, with the counts of linked ids over all documents."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = crossalign.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    return rows.select("doc_id", *crossalign.SUMS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
