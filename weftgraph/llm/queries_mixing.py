"""Query of operator 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.llm import mixing
from weftgraph.llm.shared import written

CATALOG = Catalog()
#: The tables name no domain; four are made of the sources' numbers.
DOMAIN = "coalesce('domain' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4), 'none')"
WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain0", "en"): 3, ("domain1", "de"): 2, ("domain0", "en", "src0"): 2, ("domain3", "fr"): 0}
SHARE, SEED, EPOCHS = (4, 5), 20, 4


def with_tree(docs):
    return docs.withColumn("domain", F.expr(DOMAIN.replace("CAST(", "try_cast("))).withColumn("tokens", mixing.n_tokens())


SQL = f"""WITH d AS (SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4), 'none') AS domain, lang, source,
 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
 {mixing.tree_sql("d", f"sum(tokens) * {SHARE[0]} // {SHARE[1]} FROM d", WEIGHTS, EPOCHS)},
 plan AS (SELECT l.domain, l.lang, l.source, g.given // l.tokens AS full_epochs, g.given % l.tokens AS rest FROM leaves l JOIN given_2 g ON l.domain IS NOT DISTINCT FROM g.domain AND l.lang IS NOT DISTINCT FROM g.lang AND l.source IS NOT DISTINCT FROM g.source),
 o AS (SELECT d.*, full_epochs, rest, md5(concat_ws('|', '{SEED}', full_epochs::VARCHAR, coalesce(doc_id::VARCHAR, '-'), tokens::VARCHAR)) AS k FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source WHERE tokens > 0),
 s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)
 SELECT doc_id, domain, lang, source, tokens::BIGINT AS n_tokens, full_epochs::BIGINT AS epoch, least(tokens, rest - start)::BIGINT AS taken_tokens FROM s WHERE start < rest
 UNION ALL SELECT doc_id, domain, lang, source, tokens::BIGINT, e::BIGINT, tokens::BIGINT FROM (SELECT *, unnest(range(full_epochs::BIGINT)) AS e FROM o)"""


@CATALOG.add("op1_hierarchical_mixing", sql=SQL, covers="llm 1")
def op1_hierarchical_mixing(spark, sf_dir):
    """Four fifths of all tokens, mixed to the weights."""
    docs = with_tree(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    rows = written(docs.drop("text"), "tokens")
    out = mixing.mixed(rows, SHARE, WEIGHTS, SEED, EPOCHS)
    return out.select("doc_id", "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "epoch", "taken_tokens")
