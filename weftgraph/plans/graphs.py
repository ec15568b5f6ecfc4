"""Graph algorithms, retrieval, writes, streams and files over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.functions import text as X
from weftgraph.lang import Session
from weftgraph.operators import search as R
from weftgraph.operators import traverse as G
from weftgraph.operators import versions as V
from weftgraph.operators.graph import graph_of_tables
from weftgraph.operators.indexes import SparseIndex
from weftgraph.operators.lineage import cut, fresh_folder
from weftgraph.plans.relational import G_EDGES
from weftgraph.session import stream_of, table
from weftgraph.sources import readers
from weftgraph.sources.logs import Folder
from weftgraph.streaming import streams

CATALOG = Catalog()
q = CATALOG.add
GEO = ["LIVES_IN", "BASED_IN", "IN_REGION"]
GEO_SQL = f"g AS (SELECT source, target, weight FROM ({G_EDGES}) WHERE type IN ('LIVES_IN', 'BASED_IN', 'IN_REGION'))"
UND = f"{GEO_SQL}, e AS (SELECT DISTINCT * FROM (SELECT source AS s, target AS t FROM g UNION ALL SELECT target, source FROM g))"


def geo(spark, d):
    g = graph_of_tables(spark, d)
    nodes = g.scan("Customer").select("id").union(g.scan("Supplier").select("id")).union(g.scan("Nation").select("id")).union(g.scan("Region").select("id"))
    return g.all_edges(GEO), nodes


GEO_NODES = "n AS (SELECT 'C:' || c_custkey AS id FROM customer UNION ALL SELECT 'S:' || s_suppkey FROM supplier UNION ALL SELECT 'N:' || n_nationkey FROM nation UNION ALL SELECT 'R:' || r_regionkey FROM region)"


@q("khop", f"WITH RECURSIVE {UND}, w(id, d) AS (SELECT 'N:3', 0 UNION SELECT t, d + 1 FROM w JOIN e ON s = id WHERE d < 3) SELECT id, min(d)::BIGINT AS distance FROM w GROUP BY id HAVING min(d) > 0", "G4 G2 G9")
def khop(spark, d):
    return G.reachable(geo(spark, d)[0], spark.createDataFrame([("N:3",)], "id string"), 3, "both").withColumn("distance", F.col("distance").cast("long"))


@q("bfs_depth", f"WITH RECURSIVE {GEO_SQL}, w(st, id, d) AS (SELECT 'S:' || s_suppkey, 'S:' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 50 = 0 UNION SELECT st, target, d + 1 FROM w JOIN g ON source = id WHERE d < 4) SELECT st AS start, id, min(d)::BIGINT AS distance FROM w GROUP BY 1, 2 HAVING min(d) > 0", "G2 G9")
def bfs_depth(spark, d):
    starts = graph_of_tables(spark, d).scan("Supplier").filter("s_suppkey % 50 = 0")  # the stated set of starts
    return G.bfs(geo(spark, d)[0], starts, 4).withColumn("distance", F.col("distance").cast("long"))


@q(
    "shortest_path",
    f"WITH RECURSIVE {UND}, w(id, d, p) AS (SELECT 'C:5', 0, ['C:5'] UNION SELECT t, d + 1, list_append(p, t) FROM w JOIN e ON s = id WHERE d < 5 AND t IN (SELECT 'N:' || n_nationkey FROM nation UNION ALL SELECT 'R:' || r_regionkey FROM region UNION ALL SELECT 'S:3')) SELECT max(d)::BIGINT AS steps FROM (SELECT d FROM w WHERE id = 'S:3' ORDER BY d LIMIT 1)",
    "G5",
)
def shortest_path(spark, d):
    path = G.shortest_path(geo(spark, d)[0], "C:5", "S:3", 6)
    return path.agg(F.max("step").cast("long").alias("steps"))


@q(
    "statement_shortest_path",
    "WITH p AS (SELECT a.n_regionkey AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 0 AND b.n_nationkey = 5) SELECT 0 AS step, 'N:0' AS id FROM p UNION ALL SELECT 1, 'R:' || r FROM p UNION ALL SELECT 2, 'N:5' FROM p",
    "G5 G14",
)
def statement_shortest_path(spark, d):
    return Session(spark, graph_of_tables(spark, d)).run("SHORTEST_PATH FROM 'N:0' TO 'N:5' VIA EDGES (LIVES_IN, IN_REGION) MAX_DEPTH 6")


def _pagerank_sql(rounds: int) -> str:
    parts = ["r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(sum(r{k}.r / o.c), 0) AS r FROM n LEFT JOIN e ON e.t = n.id LEFT JOIN r{k} ON r{k}.id = e.s LEFT JOIN o ON o.s = e.s GROUP BY n.id)")
    return f"WITH {UND}, {GEO_NODES}, o AS (SELECT s, count(*) AS c FROM e GROUP BY 1), {', '.join(parts)} SELECT id, round(r, 9) AS rank FROM r{rounds}"


@q("pagerank", _pagerank_sql(5), "G6 G7")
def pagerank(spark, d):
    edges, nodes = geo(spark, d)
    return G.pagerank_undirected(edges, nodes, 0.85, 5).withColumn("rank", F.round("rank", 9))


@q("pagerank_directed", None, "G7")
def pagerank_directed(spark, d):
    edges, nodes = geo(spark, d)
    return G.pagerank_directed(edges, nodes, 0.85, 30, 1e-6)[0].withColumn("rank", F.round("rank", 6))


@q("components", f"WITH RECURSIVE {UND}, {GEO_NODES}, w(root, id) AS (SELECT 'R:' || r_regionkey, 'R:' || r_regionkey FROM region UNION SELECT root, t FROM w JOIN e ON s = id), c AS (SELECT w.id, min(x.id) AS component FROM w JOIN w x ON x.root = w.root GROUP BY w.root, w.id) SELECT n.id, coalesce(c.component, n.id) AS component FROM n LEFT JOIN c ON c.id = n.id", "G8")
def components(spark, d):
    return G.components(*geo(spark, d))


def _labels_sql(rounds: int) -> str:
    parts = ["u AS (SELECT DISTINCT s, t FROM e)", "l0 AS (SELECT DISTINCT id, id AS c FROM n)"]
    for k in range(rounds):
        parts.append(f"v{k} AS (SELECT u.t AS id, l.c, count(*) AS votes FROM u JOIN l{k} l ON u.s = l.id GROUP BY 1, 2), b{k} AS (SELECT id, c FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, c) = 1)")
        parts.append(f"l{k + 1} AS (SELECT l.id, coalesce(b.c, l.c) AS c FROM l{k} l LEFT JOIN b{k} b ON b.id = l.id)")
    return f"WITH {UND}, {GEO_NODES}, {', '.join(parts)} SELECT id, c AS community FROM l{rounds}"


@q("label_propagation", _labels_sql(4), "G12")
def label_propagation(spark, d):
    return G.label_propagation(*geo(spark, d), rounds=4)


@q("closeness", "SELECT 'N:' || n_nationkey AS id, round(c / (1.0 + 2 * (c - 1)), 8) AS closeness FROM (SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey)::DOUBLE AS c FROM nation)", "G11")
def closeness(spark, d):
    g = graph_of_tables(spark, d)
    edges = g.all_edges(["IN_REGION"])
    return G.closeness(edges, g.scan("Nation").select("id"), 4).withColumn("closeness", F.round("closeness", 8))


@q("betweenness", f"WITH x AS (SELECT n_regionkey AS k, count(*) AS c FROM nation GROUP BY 1) SELECT 'N:' || n_nationkey AS id, 0.0::DOUBLE AS betweenness FROM nation UNION ALL SELECT 'R:' || r_regionkey, coalesce(c * (c - 1) / 2.0, 0.0)::DOUBLE FROM region LEFT JOIN x ON k = r_regionkey", "G11")
def betweenness(spark, d):
    g = graph_of_tables(spark, d)
    nodes = g.scan("Nation").select("id").union(g.scan("Region").select("id"))
    return G.betweenness(g.all_edges(["IN_REGION"]), nodes, 4).withColumn("betweenness", F.round("betweenness", 6))


@q("degree_centrality", f"WITH {GEO_SQL} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM g UNION ALL SELECT target FROM g) GROUP BY 1", "G10 A11")
def degree_centrality(spark, d):
    return graph_of_tables(spark, d).degrees(GEO).select("id", "degree")


@q("signal_propagation", f"WITH {GEO_SQL}, a AS (SELECT 'C:' || c_custkey AS id, 1.0 AS s FROM customer WHERE c_custkey % 50 = 0), b AS (SELECT target AS id, max(s * weight * 0.7) AS s FROM a JOIN g ON source = id GROUP BY 1), c AS (SELECT target AS id, max(s * weight * 0.7) AS s FROM b JOIN g ON source = id GROUP BY 1) SELECT id, round(s, 8) AS strength, 1::BIGINT AS distance FROM b UNION ALL SELECT id, round(s, 8), 2 FROM c", "G18")
def signal_propagation(spark, d):
    starts = graph_of_tables(spark, d).scan("Customer").filter("c_custkey % 50 = 0").select("id", F.lit(1.0).alias("strength"))
    out = G.propagate(geo(spark, d)[0], starts, 3, 0.1, 0.7)
    return out.select("id", F.round("strength", 8).alias("strength"), F.col("distance").cast("long").alias("distance"))


@q("budgeted_hops", None, "G16")
def budgeted_hops(spark, d):
    edges, nodes = geo(spark, d)
    return G.budgeted_hops(edges, spark.createDataFrame([("R:1",)], "id string"), nodes.withColumn("cost", F.length("id").cast("long")), 2, 200)


# -- writes -------------------------------------------------------------------------------------------------


@q("bulk_merge", "SELECT coalesce(b.k, a.k) AS id, coalesce(b.name, a.name) AS name, coalesce(a.n, 0) + coalesce(b.n, 0) AS mention_count FROM (SELECT c_custkey AS k, c_name AS name, 1 AS n FROM customer) a FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_name END AS name, 2 AS n FROM supplier) b ON a.k = b.k", "S28 M18")
def bulk_merge(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("mention_count"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.lit(2).alias("mention_count"))
    return V.bulk_merge(old, new)


@q("update_versioned", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS version FROM customer", "M3 M9")
def update_versioned(spark, d):
    c = table(spark, d, "customer").withColumn("version", F.lit(1))
    return V.checked_update(c, F.col("c_acctbal") < 0, 1, {"c_mktsegment": F.lit("debt")}).select("c_custkey", "c_mktsegment", "version")


@q("stale_flags", "SELECT 'N:' || n_nationkey AS id, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 6) AS stale FROM nation", "M10")
def stale_flags(spark, d):
    g = graph_of_tables(spark, d)
    return V.stale_flags(g.scan("Nation").select("id"), g.all_edges(["LIVES_IN"]), g.scan("Customer").filter("c_custkey < 6"))


@q("node_merge", "WITH e AS (SELECT 'S:' || (CASE WHEN l_suppkey % 10 < 3 THEN l_suppkey - l_suppkey % 10 ELSE l_suppkey END) AS source, 'P:' || l_partkey AS target FROM lineitem) SELECT source, target, count(*)::DOUBLE AS weight FROM e GROUP BY 1, 2", "M19 G21 C17")
def node_merge(spark, d):
    g = graph_of_tables(spark, d)
    s = g.scan("Supplier").union(g.scan("Supplier").limit(0))
    mapping = s.filter("s_suppkey % 10 < 3").select("id", F.concat(F.lit("S:"), (F.col("s_suppkey") - F.col("s_suppkey") % 10).cast("string")).alias("survivor"))
    return V.merge_nodes(g.all_edges(["SUPPLIES"]), mapping)


@q("unique_violations", "SELECT c_name, count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1 HAVING count(*) > 1", "M11 P28")
def unique_violations(spark, d):
    c = table(spark, d, "customer")
    return V.violations(c.select("c_name").unionAll(c.filter("c_custkey % 10 = 0").select("c_name")), "c_name")


@q("merge_policies", "WITH x AS (SELECT coalesce(c_custkey, s_suppkey) AS k, c_name, s_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey) SELECT k, coalesce(c_name, s_name) AS name, 'p' AS policy FROM x UNION ALL SELECT k, coalesce(s_name, c_name), 'l' FROM x", "M18")
def merge_policies(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return V.by_policy(old, new, "k", "merge_properties").withColumn("policy", F.lit("p")).unionByName(V.by_policy(old, new, "k").withColumn("policy", F.lit("l")))


# -- retrieval: the benchmark passages are the queries --------------------------------------------------------

STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
STEM_SQL = "CASE WHEN length(t) <= 3 THEN t WHEN ends_with(t, 'ies') AND length(t) > 4 THEN t[:-4] || 'y' WHEN ends_with(t, 'ing') AND length(t) > 5 THEN t[:-4] WHEN ends_with(t, 'ed') AND length(t) > 4 THEN t[:-3] WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN t[:-2] ELSE t END"


def _tokens_sql(name: str, source: str, key: str) -> str:
    """DuckDB's regular expressions have no look-around, so the camel case split marks its places by groups."""
    camel = "regexp_replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    breaks = "[\\s\\-_/.,;:!?()\\[\\]{}\"|]+"
    return (
        f"{name}_a AS (SELECT {key} AS id, unnest(string_split_regex(lower({camel}), '{breaks}')) AS t, generate_subscripts(string_split_regex(lower({camel}), '{breaks}'), 1) AS n FROM {source}), "
        f"{name} AS (SELECT id, {STEM_SQL} AS t, n FROM {name}_a WHERE length(t) BETWEEN 2 AND 100 AND t NOT IN ({STOP_SQL})), "
        f"{name}_t AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY n) AS p FROM {name} WHERE length(t) BETWEEN 2 AND 100 AND t NOT IN ({STOP_SQL}))"
    )


POSTINGS_SQL = f"{_tokens_sql('d', 'documents', 'doc_id')}, g AS (SELECT id, t || '__' || lead(t) OVER (PARTITION BY id ORDER BY p) AS t FROM d_t), post AS (SELECT t AS term, id, sum(w) AS tf FROM (SELECT t, id, 1.0 AS w FROM d_t UNION ALL SELECT t, id, 1.5 FROM g WHERE t IS NOT NULL) GROUP BY 1, 2)"
def _bm25_sql(queries: str) -> str:
    return f"""{POSTINGS_SQL}, {_tokens_sql('q', queries, 'item_id')}, q1 AS (SELECT id, t, min(p) AS p FROM q_t GROUP BY 1, 2), q2 AS (SELECT id, t FROM q1 UNION SELECT id, t FROM (SELECT id, t || '__' || lead(t) OVER (PARTITION BY id ORDER BY p) AS t FROM q1) WHERE t IS NOT NULL),
 dl AS (SELECT id, count(*) AS dl FROM post WHERE NOT contains(term, '__') GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, greatest(1.0, (SELECT sum(dl) FROM dl) / greatest(1, (SELECT count(*) FROM documents))) AS m),
 df AS (SELECT term, greatest(0.0, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1.0)) AS idf FROM post, st GROUP BY term, n),
 bm AS (SELECT q2.id AS query_id, post.id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))) AS score FROM q2 JOIN post ON post.term = q2.t JOIN df ON df.term = post.term JOIN dl ON dl.id = post.id, st GROUP BY 1, 2)"""


BM25_SQL = _bm25_sql("benchmark")
SEARCHED = "thtion of the sea"


def corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Indexes of documents that this application has written, by path, length and time of the table.
KEPT: dict[tuple, str] = {}


def kept_index(spark, d) -> SparseIndex:
    """The index of the documents: built when it is first asked for, then found again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, str(path), store.getContentSummary(path).getLength(), store.getFileStatus(path).getModificationTime())
    if key not in KEPT or Folder(KEPT[key]).get("index.json") is None:
        folder = fresh_folder(spark, "documents")
        SparseIndex.create(corpus(spark, d)[0], folder, ["text"])
        KEPT[key] = folder
    return SparseIndex(spark, KEPT[key])


@q("inverted_index_stats", f"WITH {POSTINGS_SQL} SELECT term, count(*) AS df, round(sum(tf), 4) AS tf FROM post GROUP BY 1", "R1 R2 R4 R5 R7 A30")
def inverted_index_stats(spark, d):
    return kept_index(spark, d).postings().groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("tf"), 4).alias("tf"))


@q("bm25", f"WITH {BM25_SQL} SELECT query_id, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM bm GROUP BY 1", "R6 R13 T4")
def bm25(spark, d):
    return kept_index(spark, d).bm25(corpus(spark, d)[1]).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@q("sparse_search", f"WITH {_bm25_sql(f"(SELECT 0 AS item_id, '{SEARCHED}' AS text)")} SELECT 'D:' || id AS id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, 'D:' || bm.id LIMIT 15", "R6 R13 R18")
def sparse_search(spark, d):
    return Session(spark, graph_of_tables(spark, d)).run(f"SPARSE SEARCH '{SEARCHED}' IN Document LIMIT 15").withColumn("score", F.round("score", 6))


@q("bm25_scan", f"WITH {BM25_SQL} SELECT query_id, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM bm GROUP BY 1", "R6")
def bm25_scan(spark, d):
    """The scores of bm25 without an index."""
    docs, queries = corpus(spark, d)
    return R.bm25_scan(queries, docs, ["text"]).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


PLAIN = "list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) >= 2))"
KEYWORD_SQL = f"ks AS (SELECT q.query_id, w.id, count(*) * count(*)::DOUBLE * count(*) / max(q.n) AS score FROM (SELECT doc_id AS id, unnest({PLAIN}) AS t FROM documents) w JOIN (SELECT item_id AS query_id, len({PLAIN}) AS n, unnest({PLAIN}) AS t FROM benchmark) q USING (t) GROUP BY 1, 2)"


@q("keyword_score", f"WITH {KEYWORD_SQL} SELECT query_id, count(*) AS n, round(max(score), 5) AS best FROM ks GROUP BY 1", "R8")
def keyword_score(spark, d):
    docs, queries = corpus(spark, d)
    return R.keyword_score(queries, docs, {"text": 1.0}).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 5).alias("best"))


@q("rrf_hybrid", f"WITH {BM25_SQL}, {KEYWORD_SQL}, x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, id) AS r FROM bm UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, id) FROM ks) SELECT query_id, id, round(sum(0.5 / (60 + r)), 8) AS score, count(*) AS signals FROM x WHERE r <= 10 GROUP BY 1, 2", "R14 U1 W1")
def rrf_hybrid(spark, d):
    docs, queries = corpus(spark, d)
    exact = lambda df: df.withColumn("score", F.round("score", 7))  # noqa: E731  sums in another order differ in the last digits
    one = {"bm25": R.top(exact(kept_index(spark, d).bm25(queries)), 10), "keyword": R.top(exact(R.keyword_score(queries, docs, {"text": 1.0})), 10)}
    return R.rrf(one, {"bm25": 1.0, "keyword": 1.0}).withColumn("score", F.round("score", 8))


GRAMS_SQL = "unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2]) END) AS g"
FUZZY_SQL = f"""{_tokens_sql('d', 'documents', 'doc_id')}, {_tokens_sql('q', 'benchmark', 'item_id')}, qg AS (SELECT DISTINCT id, t, {GRAMS_SQL} FROM (SELECT DISTINCT id, t FROM q_t)), qn AS (SELECT id, t, count(*) AS n FROM qg GROUP BY 1, 2),
 dg AS (SELECT DISTINCT id, {GRAMS_SQL} FROM (SELECT DISTINCT id, t FROM d_t)), fz AS (SELECT qg.id AS query_id, dg.id, qg.t, count(*)::DOUBLE / max(n) AS s FROM qg JOIN qn ON qn.id = qg.id AND qn.t = qg.t JOIN dg ON dg.g = qg.g GROUP BY 1, 2, 3)"""


@q("fuzzy_trigram", f"WITH {FUZZY_SQL} SELECT query_id, count(*) AS n, round(max(best), 6) AS best FROM (SELECT query_id, id, max(s) AS best FROM fz WHERE s >= 0.6 GROUP BY 1, 2) GROUP BY 1", "R3 R11")
def fuzzy_trigram(spark, d):
    docs, queries = corpus(spark, d)
    return R.fuzzy(queries, docs, 0.6).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("similarity"), 6).alias("best"))


DOTS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
COS = f"{DOTS} / ({NORM.format('a')} * {NORM.format('b')})"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def vector_queries(spark, d):
    return vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@q("cosine_topk", f"SELECT query_id, id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5", "R12 T5 T7 J17")
def cosine_topk(spark, d):
    return R.cosine_top(vector_queries(spark, d), vectors(spark, d), 5).select("query_id", "id", F.round("score", 6).alias("score"))


@q("euclidean_topk", "SELECT query_id, id, round(score, 6) + 0.0 AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, -sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3", "T5")
def euclidean_topk(spark, d):
    top = R.cosine_top(vector_queries(spark, d), vectors(spark, d), 3, "euclidean")
    return top.select("query_id", "id", (F.round("score", 6) + 0.0).alias("score"))  # no negative zeros


@q("lsh_candidates", None, "T6 T8")
def lsh_candidates(spark, d):
    return R.lsh_top(vector_queries(spark, d), vectors(spark, d), 5, 6, 64).select("query_id", "id", F.round("score", 6).alias("score"))


@q("recency_boost", "SELECT event_id, round(1 + exp(-0.693 * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000.0 / 72.0), 8) AS boost, round(CASE WHEN value > 500 THEN 1.3 WHEN value > 100 THEN 1.15 ELSE 1.0 END * (1 + 0.1 * ln(1 + user_id)), 8) AS other FROM events", "R9 R10")
def recency_boost(spark, d):
    hours = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000
    return table(spark, d, "events").select("event_id", F.round(R.recency_boost(hours), 8).alias("boost"), F.round(R.content_boost(F.col("value")) * R.usage_boost(F.col("user_id")), 8).alias("other"))


@q("rerank_signals", "WITH x AS (SELECT user_id % 10 AS query_id, event_id, value AS relevance, event_id % 4 AS hops, value * 2 AS quality, 1.0 + event_id % 7 AS edge_weight, event_id % 3 AS feedback FROM events) SELECT event_id, round(0.4 * relevance / max(relevance) OVER w + 0.3 * CASE hops WHEN 0 THEN 1 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.2 END + 0.15 * quality / max(quality) OVER w + 0.1 * edge_weight / max(edge_weight) OVER w + 0.15 * feedback / max(feedback) OVER w, 7) AS score FROM x WINDOW w AS (PARTITION BY query_id)", "R20 W15")
def rerank_signals(spark, d):
    e = table(spark, d, "events")
    df = e.select((F.col("user_id") % 10).alias("query_id"), "event_id", F.col("value").alias("relevance"), (F.col("event_id") % 4).alias("hops"), (F.col("value") * 2).alias("quality"), (1.0 + F.col("event_id") % 7).alias("edge_weight"), (F.col("event_id") % 3).alias("feedback"))
    return R.rerank(df).select("event_id", F.round("score", 7).alias("score"))


@q("keyword_rerank", "SELECT doc_id, round(1.0 + CASE WHEN contains(lower(text), 'the and') THEN 2.0 ELSE 0 END + 1.5 * (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT) / 2 + 0.3 * (contains(lower(text)[1:100], 'the')::INT + contains(lower(text)[1:100], 'and')::INT), 6) AS score FROM documents", "R23")
def keyword_rerank(spark, d):
    return R.keyword_rerank(table(spark, d, "documents").withColumn("score", F.lit(1.0)), "the and").select("doc_id", F.round("score", 6).alias("score"))


@q("mmr", None, "R21")
def mmr(spark, d):
    docs, queries = corpus(spark, d)
    best = R.top(R.bm25_scan(queries, docs, ["text"]), 20)
    return R.mmr(best.join(docs, "id").withColumn("id", F.col("id").cast("string")), 5)


@q("retrieval_metrics", "WITH r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT source AS query_id, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), h AS (SELECT r.query_id, rank, (g.id IS NOT NULL)::INT AS good FROM r LEFT JOIN g USING (query_id, id) WHERE rank <= 10), s AS (SELECT query_id, sum(good) AS hits, min(CASE WHEN good = 1 THEN rank END) AS first, sum(good / log2(rank + 1)) AS dcg FROM h GROUP BY 1) SELECT query_id, round(hits / 10.0, 6) AS precision, round(hits / n, 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / 10.0) * (hits / n) / (hits / 10.0 + hits / n) END, 6) AS f1, round(coalesce(1.0 / first, 0), 6) AS mrr, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n), 6) AS ndcg FROM n JOIN s USING (query_id)", "A34")
def retrieval_metrics(spark, d):
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    ranked = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    good = docs.join(table(spark, d, "labels"), "doc_id").filter("quality = 1").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"))
    out = R.metrics(ranked, good, 10)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "mrr", "ndcg")})


# -- streams: run to the end of the files and compared with the batch ------------------------------------------


def stream(spark, d):
    return stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def counts():
    return [F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")]



@q("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2", "X10 X14 E3")
def stream_tumbling(spark, d):
    out = streams.to_table(streams.tumbling(stream(spark, d), "ts", "1 hour", "2 hours", ["event_type"], counts()), scratch(spark))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


@q("stream_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1", "X9")
def stream_sliding(spark, d):
    out = streams.to_table(streams.sliding(stream(spark, d), "ts", "2 hours", "1 hour", "2 hours", [], counts()), scratch(spark))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")


@q("stream_session", "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1", "X7")
def stream_session(spark, d):
    rows = streams.sessions(stream(spark, d), "ts", "4 hours", "40 days", ["user_id"], [F.count("*").alias("n")])
    out = streams.to_table(rows, scratch(spark))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@q("stream_dedup", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events", "X6")
def stream_dedup(spark, d):
    out = streams.to_table(streams.deduplicated(stream(spark, d), "ts", "60 days", ["user_id", "event_type"]).select("user_id", "event_type"), scratch(spark), "append")
    return out.agg(F.count("*").alias("n"))


@q("stream_interval_join", "SELECT a.event_id AS purchase, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR", "X11 J6")
def stream_interval_join(spark, d):
    a = stream(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("ta"))
    b = stream(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("error"), "user_id", F.col("ts").alias("tb"))
    return streams.to_table(streams.aligned(a, b, "ta", "tb", "1 HOUR", "1 hour", "user_id").select("purchase", "error"), scratch(spark), "append")


@q("stream_changes", "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')", "X3 X5")
def stream_changes(spark, d):
    """Emits on operations, published as files exactly once, read back."""
    folder = scratch(spark)
    rows = stream(spark, d).withColumns({"operation": F.col("event_type"), "label": F.lit("Event")})
    some = streams.changes(rows, ["signup", "purchase"], ["Event"]).select("event_id", "event_type")
    streams.published(some, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("event_id bigint, event_type string").parquet(f"{folder}/out")


# -- files ---------------------------------------------------------------------------------------------------


def scratch(spark) -> str:
    return fresh_folder(spark, "files")


@q("load_csv", "SELECT n_nationkey, n_name FROM nation", "S8 S9")
def load_csv(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").coalesce(1).write.csv(path, header=True, sep=";")
    df = Session(spark, graph_of_tables(spark, d)).run(f"LOAD CSV '{path}' INTO n WITH DELIMITER = ';', HEADER = TRUE; SELECT n_nationkey, n_name FROM n")
    return df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@q("load_json", "SELECT r_regionkey, r_name FROM region", "S10 S18")
def load_json(spark, d):
    path = scratch(spark)
    table(spark, d, "region").select(F.struct("r_regionkey", F.struct("r_name").alias("r")).alias("x")).write.json(path)
    return readers.read_json(spark, path, flat=True, schema="x struct<r_regionkey: int, r: struct<r_name: string>>").select(F.col("x_r_regionkey").alias("r_regionkey"), F.col("x_r_r_name").alias("r_name"))


@q("load_xml", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region", "S8")
def load_xml(spark, d):
    path = scratch(spark)
    table(spark, d, "region").coalesce(1).write.option("rowTag", "row").format("xml").save(path)
    return readers.read_xml(spark, path, "row").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


def written_text(df, path: str) -> str:
    """A file of the lines of a small table, in order of k, below a new folder."""
    df.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


def xml_of(nodes, edges):
    """GraphML lines (k, value) of nodes (id, name) and edges (source, target)."""
    node = nodes.select(F.lit(1).alias("k"), F.format_string('<node id="%s"><data key="name">%s</data></node>', "id", "name").alias("value"))
    edge = edges.select(F.lit(2).alias("k"), F.format_string('<edge source="%s" target="%s"><data key="kind">IN_REGION</data></edge>', "source", "target").alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "<graphml><graph>"), (3, "</graph></graphml>")], "k int, value string")
    return ends.unionByName(node).unionByName(edge)


@q("load_graphml", "SELECT 'N:' || n_nationkey AS id, n_name AS name, 'R:' || n_regionkey AS target FROM nation UNION ALL SELECT 'R:' || r_regionkey, r_name, NULL FROM region", "S16")
def load_graphml(spark, d):
    """Nations and regions written as GraphML, read back, each nation with the end of its edge."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    id_of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = n.select(id_of("N:", "n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(r.select(id_of("R:", "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    edges = n.select(id_of("N:", "n_nationkey").alias("source"), id_of("R:", "n_regionkey").alias("target"))
    found, links = readers.graphml(spark, written_text(xml_of(nodes, edges), scratch(spark)))
    return found.join(links.select(F.col("source").alias("id"), "target"), "id", "left").select("id", F.col("data")["name"].alias("name"), "target")


@q("load_triples", "SELECT 'urn:part:' || p_partkey AS subject, 'urn:brand' AS predicate, 'urn:' || p_brand AS object, NULL AS literal FROM part UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:name', NULL, p_name FROM part", "S16")
def load_triples(spark, d):
    """All parts as N-Triples, a link and a literal each, read back."""
    p = table(spark, d, "part")
    one = lambda end, *c: p.select(F.format_string(f"<urn:part:%d> {end} .", "p_partkey", *c).alias("value"))
    path = scratch(spark)
    one("<urn:brand> <urn:%s>", "p_brand").unionByName(one('<urn:name> "%s"', "p_name")).write.text(path)
    return readers.triples(spark, path)


@q("load_jsonld", "SELECT 'urn:nation:' || n_nationkey AS subject, 'region' AS predicate, 'urn:region:' || n_regionkey AS object FROM nation UNION ALL SELECT 'urn:nation:' || n_nationkey, 'name', n_name FROM nation", "S16")
def load_jsonld(spark, d):
    """Nations as one JSON-LD array, links by @id, read back."""
    n = table(spark, d, "nation")
    record = F.to_json(F.struct(F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string")).alias("@id"), F.struct(F.concat(F.lit("urn:region:"), F.col("n_regionkey").cast("string")).alias("@id")).alias("region"), F.col("n_name").alias("name")))
    lines = n.select(F.lit(1).alias("k"), F.concat(record, F.lit(",")).alias("value"))
    ends = spark.createDataFrame([(0, "["), (2, "{}]")], "k int, value string")
    path = written_text(lines.unionByName(ends), scratch(spark))
    return readers.jsonld(spark, path)


@q("parse_records", "SELECT event_id, user_id, value FROM events", "S14")
def parse_records(spark, d):
    """Events as JSON lines, parsed by a schema."""
    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value"))
    return readers.parse_records(lines, "event_id bigint, user_id bigint, value double")


@q("chat_turns", "SELECT conv_id AS chat_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS turn, role, md5(text) AS h FROM conversations", "S15")
def chat_turns(spark, d):
    """Conversations as exported chats, a row with its messages each, taken apart into turns again."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    chats = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("chat_id")).agg(m.alias("messages"))
    return readers.turns(chats).select("chat_id", F.col("turn").cast("long").alias("turn"), "role", F.md5(F.col("text").cast("binary")).alias("h"))


@q("parquet_roundtrip", "SELECT 'N:' || n_nationkey AS id, n_name AS name, 'Nation' AS label FROM nation UNION ALL SELECT 'R:' || r_regionkey, r_name, 'Region' FROM region", "S17 S19 S27 M16")
def parquet_roundtrip(spark, d):
    from weftgraph.operators.graph import PropertyGraph

    g, path = graph_of_tables(spark, d), scratch(spark)
    small = PropertyGraph({k: g.nodes[k] for k in ("Nation", "Region")}, {"IN_REGION": g.edges["IN_REGION"]})
    readers.write_graph(small, path)
    return spark.read.parquet(f"{path}/nodes/label=Nation").select("id", "name", F.lit("Nation").alias("label")).unionByName(spark.read.parquet(f"{path}/nodes/label=Region").select("id", "name", F.lit("Region").alias("label")))


@q("json_extract", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events", "S10 E11")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@q("content_reads", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'", "S23 S24 J23")
def content_reads(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


@q("timeseries_latest", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", "S25 T10")
def timeseries_latest(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return readers.latest_by_key(e, ["user_id"], "o").select("user_id", "event_id", "value")


@q("sql_passthrough", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1", "S26 S11")
def sql_passthrough(spark, d):
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {o} WHERE o_totalprice > :least GROUP BY 1", args={"least": 50000}, o=table(spark, d, "orders"))


@q("defined_function", "SELECT c_custkey, upper(c_mktsegment) || '!' AS shout FROM customer", "DEFINE FUNCTION")
def defined_function(spark, d):
    Session(spark, graph_of_tables(spark, d)).run("DEFINE FUNCTION shout(x) AS RETURN \"concat(upper(x), '!')\"")
    return table(spark, d, "customer").selectExpr("c_custkey", "shout(c_mktsegment) AS shout")


@q("explain_statement", "SELECT 'Customer' AS label, true AS columnar_scan, true AS filter_reaches_scan", "P29")
def explain_statement(spark, d):
    """What EXPLAIN tells of a statement that it doesn't run."""
    plan = Session(spark, graph_of_tables(spark, d)).run("EXPLAIN SELECT id FROM Customer WHERE c_custkey < 50")
    return spark.createDataFrame([("Customer", "Scan parquet" in plan, "PushedFilters: [" in plan and "LessThan(c_custkey,50)" in plan)], "label string, columnar_scan boolean, filter_reaches_scan boolean")
