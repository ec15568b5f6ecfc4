"""Query of operator 5."""

from __future__ import annotations

from weftgraph.catalog import Catalog
from weftgraph.llm import dac

CATALOG = Catalog()
END = 2


@CATALOG.add("op5_addressable_codes", covers="llm 5")
def op5_addressable_codes(spark, sf_dir):
    """Ids of every whole document, from the files; the digest is of the ids as read back."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = dac.stored(docs, P.path("word_bpe_49k.json"), END)
    return dac.digests(dac.starts(files).repartition(max(1, min(10_000, files.count())), "file"))
