"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import licenses
from weftgraph.llm.shared import written

CATALOG = Catalog()


@CATALOG.add("op6_license_diagonals", covers="llm 6")
def op6_license_diagonals(spark, sf_dir):
    """Labels of every whole document; rows get a key as they are written without their texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = licenses.marked(docs).select("doc_id", "n_words", "candidates", F.monotonically_increasing_id().alias("row_key"))
    rows = written(rows, "marked")  # the file fixes the keys
    found = licenses.by_row(licenses.spans(licenses.hits(rows, "row_key")))
    out = rows.join(found, F.col("row_key") == F.col("key"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
