"""Entity resolution, selection under budgets, and composed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.catalog import Catalog
from weftgraph.operators import resolve as E
from weftgraph.operators import search as R
from weftgraph.operators import versions as V
from weftgraph.plans.graphs import corpus
from weftgraph.session import table

CATALOG = Catalog()
q = CATALOG.add


@q(
    "entity_resolution",
    "WITH a AS (SELECT p_partkey AS id, lower(trim(substr(p_name, 3))) AS x FROM part), b AS (SELECT n_nationkey AS id, lower(trim(n_name)) AS x FROM nation UNION ALL SELECT 100 + p_partkey, lower(trim(p_name)) FROM part), s AS (SELECT a.id, b.id AS known_id, least(length(a.x), length(b.x))::DOUBLE / greatest(length(a.x), length(b.x)) AS likeness FROM a JOIN b ON contains(a.x, b.x) OR contains(b.x, a.x)) SELECT id, known_id, round(likeness, 9) AS likeness, CASE WHEN likeness >= 0.9 THEN 'merge' ELSE 'alias' END AS action FROM s WHERE likeness >= 0.4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY likeness DESC, known_id DESC) = 1",
    "C16 J16",
)
def entity_resolution(spark, d):
    """Names of parts without their first two letters, so inside of words, against the whole names and those of nations."""
    one = lambda df, id, name: df.select(id.alias("id"), F.lit("Thing").alias("label"), name.alias("name"))
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    known = one(n, F.col("n_nationkey").cast("long"), F.col("n_name")).unionByName(one(p, F.col("p_partkey") + 100, F.col("p_name")))
    return E.entity_matches(one(p, F.col("p_partkey"), F.expr("substring(p_name, 3)")), known).withColumn("likeness", F.round("likeness", 9))


@q("canonical_names", "SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY lower(c_mktsegment)) AS survivor, sum(2) OVER (PARTITION BY lower(c_mktsegment))::BIGINT AS mention_count FROM customer", "C17")
def canonical_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.lit(2).alias("mention_count"))
    return E.canonical(c)


@q("star_merge", None, "G21")
def star_merge(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("label"), F.col("s_name").alias("name"))
    return E.star_groups(s)


@q("budget_selection", None, "C37")
def budget_selection(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_id") % 50 + 1).alias("cost"))
    return E.within_budget(e, "user_id", 120)


@q(
    "quality_gate",
    "WITH x AS (SELECT user_id % 5 AS query_id, event_id AS id, event_type AS label, 'n' || event_id % 400 AS name, value AS relevance, value AS quality, (event_id % 9)::DOUBLE AS freshness FROM events), a AS (SELECT *, max(quality) OVER (PARTITION BY query_id) AS best FROM x), b AS (SELECT * FROM a WHERE quality >= greatest(20, 0.4 * best) QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY relevance DESC, id) = 1), c AS (SELECT query_id, id, label, round(0.6 * relevance / max(relevance) OVER w + 0.25 * quality / max(quality) OVER w + 0.15 * freshness / max(freshness) OVER w, 8) AS rank_score FROM b WINDOW w AS (PARTITION BY query_id)) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank_score DESC, id) <= 5",
    "R25 W2 W15",
)
def quality_gate(spark, d):
    e = table(spark, d, "events")
    x = e.select((F.col("user_id") % 5).alias("query_id"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.concat(F.lit("n"), (F.col("event_id") % 400).cast("string")).alias("name"), F.col("value").alias("relevance"), F.col("value").alias("quality"), (F.col("event_id") % 9).cast("double").alias("freshness"))
    return E.quality_gate(x).withColumn("rank_score", F.round("rank_score", 8))


@q("query_expansion", None, "R19 R18")
def query_expansion(spark, d):
    docs, queries = corpus(spark, d)
    best = R.top(R.bm25_scan(queries, docs, ["text"]), 10)
    return E.expansion_terms(best, docs, R.query_terms(queries)).groupBy("query_id").agg(F.count("*").alias("n"))


@q("hybrid_index_search", None, "")
def hybrid_index_search(spark, d):
    docs, queries = corpus(spark, d)
    named = docs.select("id", F.col("id").cast("string").alias("name"))
    first = R.top(R.bm25_scan(queries, docs, ["text"]), 5).join(named, "id")
    fuzzy = R.top(R.fuzzy(queries, docs, 0.7).withColumnRenamed("similarity", "score"), 5).join(named, "id")
    return E.with_priority([first, fuzzy]).select("query_id", "id", F.round("score", 5).alias("score"))


@q("fact_conflicts", None, "E22")
def fact_conflicts(spark, d):
    """What all parts of a brand, type and size are said to be, in whole texts."""
    said = F.concat_ws(" ", "p_name", F.lit("of size"), "p_size", F.lit("costs"), "p_retailprice")
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("subject"), said.alias("text"))
    return E.conflicts(c).withColumn("ratio", F.round("ratio", 6))


@q("memory_recall", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1", "E25")
def memory_recall(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return E.recall(e, "user_id", "ts", at="2024-01-10").select("user_id", "event_id")


@q("replay_fork", "SELECT 'again' AS run, turn AS step, role FROM conversations WHERE conv_id = 3 AND turn <= 2", "E28")
def replay_fork(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("run"), F.col("turn").alias("step"), "role")
    return E.forked(c, "3", 2, "again")


@q("restore_version", "WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders) SELECT * FROM v UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, (SELECT max(version) + 1 FROM v w WHERE w.o_custkey = v.o_custkey) FROM v WHERE version = 2", "E6")
def restore_version(spark, d):
    o = table(spark, d, "orders")
    versions = o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version"))
    return V.restore_version(versions, "o_custkey", "version", 2).withColumn("version", F.col("version").cast("long"))


@q("correlation_expiry", "SELECT event_id, event_type AS label FROM events WHERE NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-20')", "E24")
def correlation_expiry(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("computed_at"))
    return V.expired(e, "view", "computed_at", 10, F.lit("2024-01-30").cast("timestamp")).select("event_id", "label")


@q("indicator_over_time", "SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, user_id, value FROM events WHERE contains(lower(event_type), 'purch') AND ts >= TIMESTAMP '2024-01-10'", "E13")
def indicator_over_time(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = V.indicator_over_time(e, F.col("event_type"), "PURCH", "ts", F.lit("2024-01-10").cast("timestamp"))
    return out.select(F.col("date").cast("string").alias("date"), "event_id", "user_id", "value")


@q("domain_filter", "SELECT c_custkey FROM customer WHERE coalesce(CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_acctbal < 0 THEN 'debt' END, lower(c_mktsegment)) = 'machinery'", "P18")
def domain_filter(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_acctbal > 5000 THEN 'rich' END AS domain"), F.expr("CASE WHEN c_acctbal < 0 THEN 'debt' END AS _domain"), F.lower("c_mktsegment").alias("_schema"))
    return V.of_domain(c, "machinery").select("c_custkey")


@q("columnar_select", "SELECT p_partkey, p_name FROM part WHERE p_size = 10", "P19")
def columnar_select(spark, d):
    """Two columns by an equality: both reach the Parquet scan."""
    return table(spark, d, "part").filter("p_size = 10").select("p_partkey", "p_name")


@q("case_insensitive_filter", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", "P14")
def case_insensitive_filter(spark, d):
    return table(spark, d, "customer").filter(F.lower("c_mktsegment") == "bUiLdInG".lower()).select("c_custkey")


@q("entity_boost", "WITH w AS (SELECT DISTINCT user_id % 5 AS query_id, event_type AS name FROM events WHERE value > 2 * (SELECT avg(value) FROM events)) SELECT e.user_id % 5 AS query_id, e.event_id AS id, round(e.value * CASE WHEN w.name IS NULL THEN 1.0 ELSE 1.5 END, 6) AS score FROM events e LEFT JOIN w ON w.query_id = e.user_id % 5 AND w.name = e.event_type", "R22")
def entity_boost(spark, d):
    e = table(spark, d, "events").withColumn("query_id", F.col("user_id") % 5)
    ranked = e.select("query_id", F.col("event_id").alias("id"), F.col("value").alias("score"))
    mean = e.agg(F.avg("value").alias("mean"))
    wanted = e.join(F.broadcast(mean), F.col("value") > 2 * F.col("mean")).select("query_id", F.col("event_type").alias("name")).distinct()  # one row
    return E.entity_boost(ranked, e.select(F.col("event_id").alias("id"), F.col("event_type").alias("name")), wanted).withColumn("score", F.round("score", 6))
