"""Combined searches over documents, their first words and sources, and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.operators import hybrid
from weftgraph.operators import search as R
from weftgraph.plans.graphs import KEYWORD_SQL, _bm25_sql, corpus, kept_index, vectors
from weftgraph.session import table

CATALOG = Catalog()
q = CATALOG.add
FIRST = r"^\s*([^\s.,;:!?()]{4,})"


def linked(spark, d):
    """Nodes (id, label, name, snippet) and edges (source, target, type): documents, the words that they begin with, as entities,
    and their sources."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", F.lower(F.regexp_extract("text", FIRST, 1)).alias("word"))
    own = docs.select(F.concat(F.lit("D:"), "doc_id").alias("id"), F.lit("Document").alias("label"), F.substring("text", 1, 80).alias("name"), F.col("text").alias("snippet"))
    words = docs.filter("word <> ''").select("word").distinct().select(F.concat(F.lit("E:"), "word").alias("id"), F.lit("Entity").alias("label"), F.col("word").alias("name"), F.lit("").alias("snippet"))
    sources = docs.select("source").distinct().select(F.concat(F.lit("X:"), "source").alias("id"), F.lit("Link").alias("label"), F.concat(F.lit("source "), "source").alias("name"), F.lit("").alias("snippet"))
    doc, word = F.concat(F.lit("D:"), "doc_id"), F.concat(F.lit("E:"), "word")
    held = docs.filter("word <> ''")
    edges = held.select(doc.alias("source"), word.alias("target"), F.lit("BEGINS_WITH").alias("type")).unionByName(held.select(word.alias("source"), doc.alias("target"), F.lit("BEGINS").alias("type")))
    edges = edges.unionByName(docs.select(doc.alias("source"), F.concat(F.lit("X:"), "source").alias("target"), F.lit("FROM").alias("type")))
    return own.unionByName(words).unionByName(sources), edges


def as_nodes(df):
    return df.withColumn("id", F.concat(F.lit("D:"), "id"))


def near(spark, d):
    """The vectors of documents are those of their number."""
    rows = as_nodes(vectors(spark, d))

    def neighbours(ids):
        asked = rows.join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), "vector")
        found = R.ranked_by(R.cosine_top(asked, rows, 4).filter("query_id <> id").drop("rank"))
        return found.select(F.col("query_id").alias("id"), F.col("id").alias("near"), "rank")

    return neighbours


@q("combined_search", None, "R17 R18")
def combined_search(spark, d):
    """Every benchmark text as a query, with where each result came from."""
    nodes, edges = linked(spark, d)
    docs, queries = corpus(spark, d)
    found = as_nodes(kept_index(spark, d).bm25(queries)).withColumn("score", F.round("score", 7))
    fuzzy = as_nodes(R.fuzzy(queries, docs, 0.7))
    out = hybrid.combined(queries, nodes, found, edges, near(spark, d), fuzzy, 10, ["Document"])
    return out.withColumn("score", F.round("score", 5))


AGREED = f"""WITH {_bm25_sql("benchmark")}, {KEYWORD_SQL}, w AS (SELECT doc_id, lower(regexp_extract(text, '^\\s*([^\\s.,;:!?()]{{4,}})', 1)) AS word FROM documents),
 qw AS (SELECT DISTINCT item_id AS query_id, lower(regexp_replace(regexp_replace(u, '^[.,;:!?()\\[\\]{{}}"'']+', ''), '[.,;:!?()\\[\\]{{}}"'']+$', '')) AS t FROM (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS u FROM benchmark)),
 hit AS (SELECT DISTINCT query_id, word FROM qw JOIN (SELECT DISTINCT word FROM w WHERE word <> '') ON length(t) >= 3 AND contains(word, t)), five AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 'E:' || word) AS n FROM hit QUALIFY n <= 5),
 gr AS (SELECT query_id, 'D:' || doc_id AS id, min(n) AS n FROM five JOIN w USING (word) GROUP BY 1, 2), ve AS (SELECT b.item_id AS query_id, 'D:' || x.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * x.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(x.embedding, lambda v: v::DOUBLE * v::DOUBLE)))), 9) AS s FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id, embeddings x),
 sig AS (SELECT query_id, 'D:' || id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, 'D:' || id) AS r, 30 AS most, 'bm25' AS s FROM bm UNION ALL SELECT query_id, 'D:' || id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, 'D:' || id), 30, 'keyword' FROM ks
 UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id), 15, 'vector' FROM ve UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n, id), 30, 'graph' FROM gr),
 f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 10) AS score, count(*) AS signals, string_agg(s, ',' ORDER BY s) AS names FROM sig WHERE r <= most GROUP BY 1, 2)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY signals DESC, score DESC, id) AS place, id, round(score, 7) AS score, signals, names FROM f QUALIFY place <= 15"""


@q("four_signals", AGREED, "R16 R15 R14")
def four_signals(spark, d):
    """Keyword, BM25, vector and entity signals, by how many agree. A query's vector is the one of its number."""
    nodes, edges = linked(spark, d)
    docs, queries = corpus(spark, d)
    exact = lambda df: as_nodes(df).withColumn("score", F.round("score", 7))
    rows = as_nodes(vectors(spark, d))
    asked = queries.join(vectors(spark, d), F.col("query_id") == F.col("id")).select("query_id", "vector")
    signals = {
        "keyword": R.top(exact(R.keyword_score(queries, docs, {"text": 1.0})), 30), "bm25": R.top(exact(kept_index(spark, d).bm25(queries)), 30),
        "vector": R.top(R.cosine_top(asked, rows, 20).drop("rank").withColumn("score", F.round("score", 9)), 15), "graph": hybrid.entity_signal(queries, nodes, edges, 30),
    }
    return hybrid.agreed(signals, nodes, 15).withColumn("score", F.round("score", 7))
