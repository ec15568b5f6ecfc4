"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import bpe

CATALOG = Catalog()


@CATALOG.add("op10_bpe_rank_queue", covers="llm 10")
def op10_bpe_rank_queue(spark, sf_dir):
    """Every whole text to ids and back, with digests of both; the ids are the operator's own output."""
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, P.PATTERN).drop("text")
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "ids")
    return bpe.decode(coded, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
