"""Materialised views and indexes: kept up by changes, compared with SQL over the changed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.functions import text as X
from weftgraph.lang import Session
from weftgraph.operators.checkpoints import Checkpoints
from weftgraph.operators.graph import PropertyGraph, graph_of_tables
from weftgraph.operators.indexes import SparseIndex
from weftgraph.operators.lineage import fresh_folder
from weftgraph.operators.matviews import Aggregate, MaterializedView, of_log
from weftgraph.plans.graphs import SEARCHED, _bm25_sql, corpus
from weftgraph.session import table

CATALOG = Catalog()
q = CATALOG.add

ORDERS = "SELECT o_orderpriority AS priority, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price, o_orderdate, o_custkey FROM orders WHERE o_orderkey % 5 <> 0"
AGGREGATES = [
    Aggregate("n", "COUNT"), Aggregate("total", "SUM", "o_totalprice"), Aggregate("mean", "AVG", "o_totalprice"), Aggregate("first", "MIN", "o_orderdate"),
    Aggregate("last", "MAX", "o_orderdate"), Aggregate("customers", "COUNT DISTINCT", "o_custkey"),
]


@q("view_of_changes", f"SELECT priority, status, count(*) AS n, round(sum(price), 2) AS total, round(avg(price), 4) AS mean, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(DISTINCT o_custkey) AS customers FROM ({ORDERS}) GROUP BY 1, 2", "M14")
def view_of_changes(spark, d):
    """A grouped view of three quarters of the orders, then three change batches: the rest comes, every third order changes
    its status and price, every fifth goes."""
    orders = table(spark, d, "orders")
    row = F.struct(*orders.columns)
    changed = orders.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 3 == 0, "C").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))})
    view = MaterializedView.create(orders.filter("o_orderkey % 4 <> 0"), fresh_folder(spark, "view"), ["o_orderpriority", "o_orderstatus"], AGGREGATES)
    none = F.lit(None).cast(orders.select(row).schema[0].dataType)
    view.apply(of_log(orders.filter("o_orderkey % 4 = 0").select(F.lit("INSERT").alias("op"), none.alias("old"), row.alias("new"))), 0)
    both = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", row.alias("old")).join(changed.select("o_orderkey", row.alias("new")), "o_orderkey")
    view.apply(of_log(both.select(F.lit("UPDATE").alias("op"), "old", "new")), 1)
    view.apply(of_log(changed.filter("o_orderkey % 5 = 0").select(F.lit("DELETE").alias("op"), row.alias("old"), none.alias("new"))), 2)
    rows = view.read().withColumnsRenamed({"o_orderpriority": "priority", "o_orderstatus": "status"})
    return rows.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4), "first": F.date_format("first", "yyyy-MM-dd"), "last": F.date_format("last", "yyyy-MM-dd")})


@q("view_statement", "SELECT CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_name) AS last FROM customer WHERE c_nationkey <> 3 GROUP BY 1", "M14")
def view_statement(spark, d):
    """A view that follows its nodes: refreshed by each change, it needs no rows but the changed ones."""
    session = Session(spark, graph_of_tables(spark, d))
    session.run("""CREATE MATERIALIZED VIEW segments AS SELECT c_mktsegment AS segment, COUNT(*) AS n, SUM(c_acctbal) AS total, MAX(c_name) AS last FROM Customer GROUP BY c_mktsegment REFRESH ON node_change;
        UPDATE NODE Customer SET c_mktsegment = 'DEBT' WHERE c_acctbal < 0; DELETE NODE Customer WHERE c_nationkey = 3""")
    return session.run("SELECT segment, n, total, last FROM segments").withColumn("total", F.round("total", 2))


SPARSE_SQL = f"WITH {_bm25_sql(f"(SELECT 0 AS item_id, '{SEARCHED}' AS text)")} SELECT 'D:' || id AS id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, 'D:' || bm.id LIMIT 15"


@q("index_search", SPARSE_SQL, "M13 R6 R13")
def index_search(spark, d):
    """A search that finds an index and reads the postings of its own terms."""
    session = Session(spark, graph_of_tables(spark, d))
    session.run("CREATE INDEX words ON Document (text) TYPE SPARSE")
    return session.run(f"SPARSE SEARCH '{SEARCHED}' IN Document LIMIT 15").withColumn("score", F.round("score", 6))


DELTA_SQL = _bm25_sql("benchmark").replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(substr(text, 1, 1)) || ' ' || text || ' ' || lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)")


@q("index_deltas", f"WITH {DELTA_SQL} SELECT query_id, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM bm GROUP BY 1", "M13 R5")
def index_deltas(spark, d):
    """An index of half of all documents takes in the rest, then changed and deleted ones, and is merged."""
    docs, queries = corpus(spark, d)
    index = SparseIndex.create(docs.filter("id % 2 = 0"), fresh_folder(spark, "index"), ["text"])
    index.update(docs.filter("id % 2 <> 0"))
    longer = F.concat(X.capital(F.substring("text", 1, 1)), F.lit(" "), "text", F.lit(" "), "lang")
    changed = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), longer.alias("text"))
    index.update(changed, docs.filter("id % 7 = 0"))
    index.update(None, docs.filter("id % 21 = 0"))
    index.merge()
    return index.bm25(queries).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@q("index_range", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01' AND o_orderstatus = 'O'", "M13 S7")
def index_range(spark, d):
    """A range of time out of a sorted index: the bounds of files and row groups leave out the rest."""
    session = Session(spark, graph_of_tables(spark, d))
    session.run("CREATE INDEX dates ON Order (o_orderdate) TYPE TEMPORAL")
    return session.run("SELECT o_orderkey, o_totalprice AS price FROM Order WHERE o_orderdate >= '1996-03-01' AND o_orderdate < '1996-04-01' AND o_orderstatus = 'O'").withColumn("price", F.round("price", 2))


@q("checkpoints", "SELECT 'before' AS name, NULL AS parent, count(*) AS customers, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'third', 'before', count(*), round(sum(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END), 2) FROM customer WHERE c_nationkey <> 3", "M16")
def checkpoints(spark, d):
    """Three states of customers and nations, the middle one deleted, the others restored and counted."""
    g = graph_of_tables(spark, d)
    graph = PropertyGraph().with_nodes("Customer", g.scan("Customer")).with_nodes("Nation", g.scan("Nation")).with_edges("LIVES_IN", g.edges["LIVES_IN"])
    kept = Checkpoints(spark, fresh_folder(spark, "checkpoints"))
    session = Session(spark, graph)
    kept.save(session.graph, "before")
    session.run("DELETE NODE Customer WHERE c_nationkey = 3")
    kept.save(session.graph, "second")
    session.run("UPDATE NODE Customer SET c_acctbal = 0 WHERE c_acctbal < 0")
    kept.save(session.graph, "third")
    kept.delete("second")
    out = None
    for r in kept.list().collect():  # one row a checkpoint
        sums = kept.restore(r.name).scan("Customer").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("total"))
        one = sums.select(F.lit(r.name).alias("name"), F.lit(r.parent).cast("string").alias("parent"), "customers", "total")
        out = one if out is None else out.unionByName(one)
    return out
