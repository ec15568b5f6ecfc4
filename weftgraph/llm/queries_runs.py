"""Query of operator 13."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import runs

CATALOG = Catalog()


def planted(keys: tuple, words: list[bytes]) -> list[bytes]:
    """The contract's repetition: of a tenth of all documents, by the digest of the id, the end repeats with a period
    drawn from that digest. Without an id nothing is planted."""
    digest = crc32(str(keys[0]).encode())
    n, g = len(words), digest // 10
    if digest % 10 or not n or keys[0] is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


@CATALOG.add("op13_periodic_runs", covers="llm 13")
def op13_periodic_runs(spark, sf_dir):
    """Runs of repeated words of every whole text, the strongest of them, and digests of all and of the text without them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = runs.periodic_runs(docs, rewrite=planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
