"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import ngram

CATALOG = Catalog()
#: Needs more disk than the check tool grants; see the README.
ORDER = 3


@CATALOG.add("op2_kneser_ney", covers="llm 2")
def op2_kneser_ney(spark, sf_dir, order: int = ORDER):
    """Scores of all whole documents by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    folder = ngram.train(docs.filter("NOT held_out"), order)
    total = ngram.Model(folder).n_tokens
    return ngram.scored(docs, folder).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
