"""Statements of the query language over the tables as a graph, with the SQL that has to agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.lang import Session
from weftgraph.operators.graph import graph_of_tables

CATALOG = Catalog()


def statement(name: str, text: str, sql: str | None, covers: str, rounded: dict[str, int] | None = None) -> None:
    """Registers a script; rounded names double columns that are rounded on both sides."""

    def run(spark, sf_dir):
        df = Session(spark, graph_of_tables(spark, sf_dir)).run(text)
        return df.withColumns({c: F.round(c, k) for c, k in (rounded or {}).items()})

    CATALOG.add(name, sql, covers)(run)


G_ALL = """SELECT 'R:' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'N:' || n_nationkey, 'Nation', n_name FROM nation
 UNION ALL SELECT 'C:' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'Supplier', s_name FROM supplier
 UNION ALL SELECT 'P:' || p_partkey, 'Part', p_name FROM part UNION ALL SELECT 'O:' || o_orderkey, 'Order', 'O:' || o_orderkey FROM orders
 UNION ALL SELECT 'D:' || doc_id, 'Document', 'D:' || doc_id FROM documents UNION ALL SELECT 'T:' || conv_id || ':' || turn, 'Turn', role FROM conversations"""
G_EDGES = """SELECT 'N:' || n_nationkey AS source, 'R:' || n_regionkey AS target, 'IN_REGION' AS type, 1.0 AS weight FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'LIVES_IN', 1.0 FROM customer
 UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'BASED_IN', 1.0 FROM supplier UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey, 'PLACED', 1.0 FROM orders
 UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'CONTAINS', l_quantity FROM lineitem UNION ALL SELECT 'O:' || l_orderkey, 'S:' || l_suppkey, 'SHIPPED_BY', 1.0 FROM lineitem
 UNION ALL SELECT 'S:' || l_suppkey, 'P:' || l_partkey, 'SUPPLIES', count(*) FROM lineitem GROUP BY ALL
 UNION ALL SELECT 'T:' || conv_id || ':' || turn, 'T:' || conv_id || ':' || nt, 'NEXT', 1.0 FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations) WHERE nt IS NOT NULL"""

S = statement
S("node_scan_all", "FIND NODES", G_ALL, "S1")
S("node_scan_label", "SELECT id, p_name, p_brand, p_size FROM Part", "SELECT 'P:' || p_partkey AS id, p_name, p_brand, p_size FROM part", "S2 P1 P2")
S("edge_scan", "SELECT EDGE WHERE type = 'LIVES_IN'", "SELECT 'C:' || c_custkey AS source, 'N:' || c_nationkey AS target, 'LIVES_IN' AS type, 1.0::DOUBLE AS weight FROM customer", "S3 P16")
S("edge_names", "FIND EDGES WHERE type = 'BASED_IN'", "SELECT 'S:' || s_suppkey AS source, 'N:' || s_nationkey AS target, 'BASED_IN' AS type, 1.0::DOUBLE AS weight, s_name AS source_name, n_name AS target_name FROM supplier JOIN nation ON n_nationkey = s_nationkey", "S3 S4 J4")
S("point_lookup", "FIND BY UUID 'C:7'", "SELECT 'C:' || c_custkey AS id, 'Customer' AS label, c_name AS name FROM customer WHERE c_custkey = 7", "S5")
S("node_filter_eq", "SELECT id, c_name FROM Customer WHERE c_mktsegment = 'BUILDING'", "SELECT 'C:' || c_custkey AS id, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", "S6 P5")
S("node_filter_coerced", "SELECT id FROM Part WHERE p_size = '7'", "SELECT 'P:' || p_partkey AS id FROM part WHERE p_size = 7", "P5")
S("node_filter_ne", "SELECT id, o_orderstatus FROM Order WHERE o_orderstatus <> 'O'", "SELECT 'O:' || o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O'", "P6")
S("node_filter_range", "SELECT id, c_acctbal FROM Customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000.5", "SELECT 'C:' || c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000.5", "S7 P7 P13")
S("node_filter_contains", "SELECT id, p_name FROM Part WHERE p_name CONTAINS 'WIDGET'", "SELECT 'P:' || p_partkey AS id, p_name FROM part WHERE contains(lower(p_name), 'widget')", "P8")
S("node_filter_prefix_suffix", "SELECT id, p_name FROM Part WHERE p_name STARTS WITH 'small' AND p_name ENDS WITH 'gear'", "SELECT 'P:' || p_partkey AS id, p_name FROM part WHERE starts_with(p_name, 'small') AND ends_with(p_name, 'gear')", "P9")
S("node_filter_in_between", "SELECT id, p_size FROM Part WHERE p_size IN (1, 5, 9) OR (p_size BETWEEN 20 AND 22 AND p_brand NOT IN ('Brand#1', 'Brand#2'))", "SELECT 'P:' || p_partkey AS id, p_size FROM part WHERE p_size IN (1, 5, 9) OR (p_size BETWEEN 20 AND 22 AND p_brand NOT IN ('Brand#1', 'Brand#2'))", "P10 P11")
S("node_filter_boolean", "MATCH NODE Order WHERE NOT (o_totalprice > 50000 OR o_orderpriority = '1-URGENT') RETURN Order.id AS id, o_totalprice", "SELECT 'O:' || o_orderkey AS id, o_totalprice FROM orders WHERE NOT (o_totalprice > 50000 OR o_orderpriority = '1-URGENT')", "P13 P15 P3")
S("node_filter_similar", "SELECT id, p_name FROM Part WHERE p_name SIMILAR TO '^[bc].* r[aeo]d$'", "SELECT 'P:' || p_partkey AS id, p_name FROM part WHERE regexp_matches(p_name, '^[bc].* r[aeo]d$')", "P12")
S("node_filter_null", "SELECT id FROM Customer WHERE missing IS NULL AND c_custkey < 50", "SELECT 'C:' || c_custkey AS id FROM customer WHERE c_custkey < 50", "P7")
S("let_variable", "LET $seg = 'MACHINERY'; LET $low = 10; SELECT id FROM Customer WHERE c_mktsegment = $seg AND c_custkey > $low", "SELECT 'C:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey > 10", "P33 P35")
S("project_alias_limit", "SELECT o_orderkey AS k, o_totalprice AS price FROM Order ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", "P1 T1 T2 T3 T4")
S("select_distinct", "SELECT DISTINCT p_brand AS brand FROM Part", "SELECT DISTINCT p_brand AS brand FROM part", "D4 A9")
S("agg_global", "SELECT COUNT(*) AS n, SUM(c_acctbal) AS total, AVG(c_acctbal) AS mean, MIN(c_acctbal) AS least, MAX(c_acctbal) AS most FROM Customer WHERE c_acctbal > 0", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer WHERE c_acctbal > 0", "A1 A2 A3 A4", {"total": 2, "mean": 4})
S("agg_empty", "SELECT COUNT(*) AS n, SUM(c_acctbal) AS total, AVG(c_acctbal) AS mean FROM Customer WHERE c_custkey < 0", "SELECT count(*) AS n, coalesce(sum(c_acctbal), 0)::DOUBLE AS total, coalesce(avg(c_acctbal), 0)::DOUBLE AS mean FROM customer WHERE c_custkey < 0", "A2 A3")
S("agg_group", "SELECT c_mktsegment, COUNT(*) AS n, SUM(c_acctbal) AS total FROM Customer WHERE c_acctbal > 0 GROUP BY c_mktsegment ORDER BY total DESC LIMIT 5", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 3 DESC LIMIT 5", "A5 T1 T3", {"total": 2})
S("agg_group_multi", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, AVG(o_totalprice) AS mean, o_orderkey FROM Order GROUP BY o_orderstatus, o_orderpriority", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2", "A5", {"mean": 4})
S("agg_having", "SELECT p_brand, COUNT(*) AS n FROM Part GROUP BY p_brand HAVING COUNT(*) > 60 AND MAX(p_size) >= 50", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 60 AND max(p_size) >= 50", "A12")
S("agg_count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS customers, COUNT(NODE o_orderkey) AS nodes FROM Order", "SELECT count(DISTINCT o_custkey) AS customers, count(*) AS nodes FROM orders", "A8")
S("agg_string_join", "SELECT n_regionkey, JOIN(n_name) AS names, UNIQUE(n_regionkey) AS regions FROM Nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, n_regionkey::VARCHAR AS regions FROM nation GROUP BY 1", "A9 A10")
S("agg_degree", "DEGREE ON PLACED", "WITH e AS (SELECT 'C:' || o_custkey AS s, 'O:' || o_orderkey AS t FROM orders) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT s AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e) GROUP BY id", "A11 G10")
S("aggregate_shorthand", "AGGREGATE AVG(o_totalprice) FROM Order GROUP BY o_orderpriority", "SELECT coalesce(o_orderpriority, 'unknown') AS o_orderpriority, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1", "A6")
S("aggregate_from_where", "AGGREGATE MAX(p_retailprice) FROM Part WHERE p_size < 10", "SELECT max(p_retailprice) AS value FROM part WHERE p_size < 10", "A7")
S("aggregate_by", "AGGREGATE Part BY p_type", "SELECT p_type, count(*) AS value FROM part GROUP BY 1", "A13")
S("count_label", "COUNT Order WHERE o_orderstatus = 'F'", "SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'F'", "A13")
S("graph_summary", "GRAPH SUMMARY ON Part RETURN {n: COUNT(*), sizes: COUNT(DISTINCT p_size), most: MAX(p_retailprice)}", "SELECT count(*) AS n, count(DISTINCT p_size) AS sizes, max(p_retailprice) AS most FROM part", "P32")
S("show_stats", "SHOW STATS", f"SELECT label, count(*) AS count FROM ({G_ALL}) GROUP BY 1", "P30 A19")
S("describe_label", "DESCRIBE NODE TYPE Nation", "SELECT * FROM (VALUES ('id', 'string'), ('name', 'string'), ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(property, type), (SELECT count(*) AS count FROM nation)", "P31")
S("match_one_hop", "MATCH (c:Customer)-[PLACED]->(o:Order) RETURN c.c_mktsegment AS c_mktsegment, COUNT(*) AS n, SUM(o.o_totalprice) AS total", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1", "J1 P4 A5", {"total": 2})
S("match_two_hop", "MATCH (c:Customer)-[PLACED]->(o:Order)-[i:CONTAINS]->(p:Part) WHERE p.p_size = 5 AND i.weight > 40 RETURN c.id AS customer, o.id AS ordered, p.id AS part, i.weight AS quantity", "SELECT 'C:' || o_custkey AS customer, 'O:' || o_orderkey AS ordered, 'P:' || p_partkey AS part, l_quantity AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 5 AND l_quantity > 40", "J1 J2 P4")
S("match_three_hop", "MATCH (o:Order)-[SHIPPED_BY]->(s:Supplier)-[BASED_IN]->(n:Nation)-[IN_REGION]->(r:Region) WHERE o.o_orderstatus = 'P' RETURN r.name AS region, COUNT(*) AS n", "SELECT r_name AS region, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'P' GROUP BY 1", "J2")
S("match_incoming", "MATCH (n:Nation)<-[LIVES_IN|BASED_IN]-(c:Customer) WHERE c.c_acctbal > 9000 RETURN n.name AS nation, c.id AS customer", "SELECT n_name AS nation, 'C:' || c_custkey AS customer FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000", "J2")
S("match_undirected", "MATCH (n:Nation {n_nationkey: 3})-[IN_REGION]-(r:Region) RETURN r.name AS region", "SELECT r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 3", "J2")
S("match_range", "MATCH (c:Customer)-[LIVES_IN|IN_REGION*1..2]->(r:Region) WHERE c.c_custkey < 40 RETURN c.id AS customer, r.name AS region", "SELECT 'C:' || c_custkey AS customer, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey < 40", "J2 G15")
S("path_functions", "MATCH (c:Customer)-[LIVES_IN]->(n:Nation)-[IN_REGION]->(r:Region) WHERE c.c_custkey < 9 RETURN c.id AS customer, PATH_LENGTH AS hops", "SELECT 'C:' || c_custkey AS customer, 2 AS hops FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey < 9", "G14")
S("induced_edges", "FIND NODES WHERE label IN ('Nation', 'Region')", "SELECT 'N:' || n_nationkey AS source, 'R:' || n_regionkey AS target, 'IN_REGION' AS type, 1.0::DOUBLE AS weight FROM nation", "P17 J3")
S("traverse_depth", "TRAVERSE FROM Customer WHERE c_custkey = 11 VIA (PLACED, CONTAINS) TO Part MAX DEPTH 2 RETURN Part.id AS id, distance", "SELECT DISTINCT 'P:' || l_partkey AS id, 2 AS distance FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 11", "G1")
S("hop_query", "HOP FROM Supplier TO Region DEPTH 2", "SELECT DISTINCT 'R:' || r_regionkey AS id, r_name AS name, r_regionkey, r_name, 2 AS distance FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey", "G13")
S("neighbors", "NEIGHBORS FROM Nation WHERE n_nationkey = 4 VIA (LIVES_IN, IN_REGION) DEPTH 1 RETURN id, label", "SELECT 'C:' || c_custkey AS id, 'Customer' AS label FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'R:' || n_regionkey, 'Region' FROM nation WHERE n_nationkey = 4", "G3 U6")
S("create_and_update", "CREATE NODE Customer {id: 'x1', name: 'Ann', c_acctbal: 40.0, c_mktsegment: 'NEW'}; INSERT INTO Customer VALUES {id: 'x2', name: 'Bo', c_acctbal: 50.0, c_mktsegment: 'NEW'}; UPDATE NODE Customer SET {c_acctbal: 41.0} WHERE name = 'Ann'; SELECT c_mktsegment, COUNT(*) AS n, MAX(c_acctbal) AS most FROM Customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY 1 UNION ALL SELECT 'NEW', 2, 50.0", "M1 M3 S29")
S("create_edge", "CREATE NODE Customer {id: 'x1', name: 'Ann'}; CREATE EDGE LIVES_IN FROM 'x1' TO 'N:3' {weight: 2}; MATCH (c:Customer)-[LIVES_IN]->(n:Nation) RETURN n.id AS nation, COUNT(*) AS n", "SELECT 'N:' || c_nationkey AS nation, count(*) + (c_nationkey = 3)::INT AS n FROM customer GROUP BY c_nationkey", "M1 M2")
S("update_nodes", "UPDATE NODES Customer SET c_mktsegment = 'NONE' WHERE c_acctbal < 0; AGGREGATE COUNT(*) FROM Customer GROUP BY c_mktsegment", "SELECT CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment, count(*) AS value FROM customer GROUP BY 1", "M4")
S("update_edge", "UPDATE EDGE PLACED SET weight = 3 WHERE source = 'C:7'; SELECT EDGE WHERE type = 'PLACED' AND weight > 2", "SELECT 'C:7' AS source, 'O:' || o_orderkey AS target, 'PLACED' AS type, 3.0::DOUBLE AS weight FROM orders WHERE o_custkey = 7", "M5")
S("delete_cascade", "DELETE NODE Nation WHERE n_regionkey = 1; SELECT EDGE WHERE type IN ('LIVES_IN', 'IN_REGION')", "SELECT 'N:' || n_nationkey AS source, 'R:' || n_regionkey AS target, 'IN_REGION' AS type, 1.0::DOUBLE AS weight FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'LIVES_IN', 1.0 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1", "M6")
S("delete_edge", "DELETE EDGE IN_REGION WHERE target = 'R:0'; SELECT EDGE WHERE type = 'IN_REGION'", "SELECT 'N:' || n_nationkey AS source, 'R:' || n_regionkey AS target, 'IN_REGION' AS type, 1.0::DOUBLE AS weight FROM nation WHERE n_regionkey <> 0", "M7")
S("merge_node", "MERGE NODE Region {r_regionkey: 0} SET {flag: 1}; MERGE NODE Region {r_name: 'ATLANTIS', id: 'R:9'}; SELECT id, r_name, flag FROM Region", "SELECT 'R:' || r_regionkey AS id, r_name, CASE WHEN r_regionkey = 0 THEN 1 END AS flag FROM region UNION ALL SELECT 'R:9', 'ATLANTIS', NULL WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS')", "M8")
S("subgraph_view", "CREATE SUBGRAPH rich AS MATCH (c:Customer)-[LIVES_IN]->(n:Nation) WHERE c.c_acctbal > 5000 RETURN c.id AS id, n.name AS nation; SELECT nation, COUNT(*) AS n FROM rich GROUP BY nation", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 GROUP BY 1", "M15")
S("merge_results", "CREATE VIEW a AS SELECT id, name FROM Region; CREATE VIEW b AS SELECT id, name FROM Nation; MERGE RESULTS (a, b)", "SELECT 'R:' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'N:' || n_nationkey, n_name FROM nation", "U4")
S("for_each", "LET $keys = [1, 2, 3]; FOR EACH $k IN $keys DO SELECT id, p_name FROM Part WHERE p_partkey = $k END", "SELECT 'P:' || p_partkey AS id, p_name FROM part WHERE p_partkey = 3", "P34")
S("spaces", "CREATE NAMESPACE other; USE NAMESPACE other; CREATE NODE Region {id: 'x', name: 'X'}; USE NAMESPACE default; DELETE NODE Region WHERE r_regionkey = 0; SELECT id, name FROM Region", "SELECT 'R:' || r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey <> 0", "M12 P30")
S("hybrid_search", "HYBRID SEARCH 'thtion retion of the sea' IN Document WITH keyword = 0.4, sparse = 0.4, similarity = 0.2 LIMIT 15", None, "R14")
