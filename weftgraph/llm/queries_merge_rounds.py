"""Query of operator 12."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import merge_rounds

CATALOG = Catalog()


@CATALOG.add("op12_merge_rounds", covers="llm 12")
def op12_merge_rounds(spark, sf_dir):
    """Every whole text to ids and back, with digests of both."""
    import public_tokenizers as P

    path = P.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = merge_rounds.encode(docs, path, packed="packed").drop("text")
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), "ids")
    return merge_rounds.decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
