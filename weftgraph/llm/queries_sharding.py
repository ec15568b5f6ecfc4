"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import sharding

CATALOG = Catalog()
SHARDS = 24


@CATALOG.add("op7_minimax_shards", covers="llm 7")
def op7_minimax_shards(spark, sf_dir):
    """All documents in shards 0 to 23 of nearly equal bytes, equal texts together."""
    out = sharding.sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
