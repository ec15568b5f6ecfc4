"""Query of operator 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import media

CATALOG = Catalog()


@CATALOG.add("op8_flac", covers="llm 8")
def op8_flac(spark, sf_dir):
    """Every whole text as samples, through FLAC and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(F.coalesce("text", F.lit("")))
    padding = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    payload = F.concat(raw, F.unhex(F.repeat(F.lit("00"), padding)))
    df = media.stored(docs.select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload"))).drop("payload")
    df = df.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    df = media.features(media.read_back(df).drop("media", "blocks"))
    size = F.octet_length("pcm")
    return df.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
