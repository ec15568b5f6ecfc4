"""Paths: impact of a signal and what would change, lineage, trails and quantified patterns from one side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.lang import Session
from weftgraph.operators import paths
from weftgraph.operators.graph import graph_of_tables

CATALOG = Catalog()
q = CATALOG.add

#: Weight and decay of a hop along each type of edge; what an order contains weighs by its quantity.
FACTORS = {"PLACED": (0.9, 0.1), "CONTAINS": (0.8, 0.1), "SHIPPED_BY": (0.8, 0.3), "BASED_IN": (0.7, 0.1), "LIVES_IN": (0.5, 0.2), "IN_REGION": (0.9, 0.2)}
RAW = """SELECT 'C:' || o_custkey AS source, 'O:' || o_orderkey AS target, 'PLACED' AS type, 1.0::DOUBLE AS w FROM orders
 UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'CONTAINS', l_quantity / 50 FROM lineitem UNION ALL SELECT 'O:' || l_orderkey, 'S:' || l_suppkey, 'SHIPPED_BY', 1.0 FROM lineitem
 UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'BASED_IN', 1.0 FROM supplier UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'LIVES_IN', 1.0 FROM customer
 UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'IN_REGION', 1.0 FROM nation"""
CASES = " ".join(f"WHEN '{t}' THEN {{{k}}}" for k, t in enumerate(FACTORS))
EDGES = f"e AS (SELECT source, target, type, w * CASE type {CASES.format(*[f'{w}::DOUBLE' for w, _ in FACTORS.values()])} END AS weight, CASE type {CASES.format(*[f'{x}::DOUBLE' for _, x in FACTORS.values()])} END AS decay FROM ({RAW}))"


def _impact_sql(edges: str = "e", n: str = "", hops: int = 3, starts: str = "SELECT 'C:' || c_custkey AS id FROM customer WHERE c_custkey % 50 = 0") -> str:
    """Levels of the queue: f<d>, then all of them as found."""
    parts = [f"{n}f0 AS (SELECT id AS start, id, 1.0::DOUBLE AS s, [id] AS path, []::VARCHAR[] AS queue FROM ({starts}))"]
    for d in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT start, id FROM {n}f{k}" for k in range(d))
        parts.append(
            f"{n}f{d} AS (SELECT start, t AS id, arg_min(v, (queue, -s, path)).s AS s, arg_min(v, (queue, -s, path)).path AS path, arg_min(v, (queue, -s, path)).queue AS queue FROM (SELECT *, struct_pack(s, path, queue) AS v FROM (SELECT start, x.target AS t, s * (weight * (1 - decay)) AS s, list_append(path, x.target) AS path, list_append(queue, type || '|' || x.target) AS queue FROM {n}f{d - 1} f JOIN {edges} x ON x.source = f.id AND x.source <> x.target) WHERE s >= 0.1) WHERE (start, t) NOT IN ({seen}) GROUP BY start, t)"
        )
    found = " UNION ALL ".join(f"SELECT *, {d} AS hops FROM {n}f{d}" for d in range(1, hops + 1))
    return ", ".join([*parts, f"{n}found AS ({found})"])


def weighted(spark, d):
    """All edges with weight and decay of their types."""
    edges = graph_of_tables(spark, d).all_edges(list(FACTORS))
    own = F.when(F.col("type") == "CONTAINS", F.col("weight") / 50).otherwise(1.0)
    by_type = [F.element_at(F.create_map(*[F.lit(x) for t, v in FACTORS.items() for x in (t, v[k])]), F.col("type")) for k in (0, 1)]
    return edges.select("source", "target", "type", (own * by_type[0]).alias("weight"), by_type[1].alias("decay"))


def sources(spark, d):
    return graph_of_tables(spark, d).scan("Customer").filter("c_custkey % 50 = 0").select("id", F.lit(-1.0).alias("value"))  # the stated set of starts


@q("impact", f"WITH {EDGES}, {_impact_sql()} SELECT start, id, round(s, 3) AS strength, hops, array_to_string(path, '>') AS path FROM found", "G19 G18")
def impact(spark, d):
    """What a signal of each start reaches in three hops over all edges, with the path of the first visit."""
    found = paths.impact(weighted(spark, d), sources(spark, d))
    return found.select("start", "id", F.round("strength", 3).alias("strength"), "hops", F.array_join("path", ">").alias("path"))



WHAT_IF = f"""WITH {EDGES}, x AS (SELECT * FROM e WHERE NOT (type = 'PLACED' AND target LIKE '%7' AND source LIKE '%0') UNION ALL SELECT 'C:' || c_custkey, 'S:1', 'ALLIED', 0.5::DOUBLE, 0.0::DOUBLE FROM customer WHERE c_custkey % 100 = 0),
 {_impact_sql()}, {_impact_sql('x', 'n')} SELECT start, id, round(coalesce(a.s, 0), 3) AS before, round(coalesce(b.s, 0), 3) AS after FROM (SELECT start, id, round(s, 4) AS s FROM found) a FULL JOIN (SELECT start, id, round(s, 4) AS s FROM nfound) b USING (start, id) WHERE coalesce(a.s, 0) <> coalesce(b.s, 0)"""


@q("impact_what_if", WHAT_IF, "G19")
def impact_what_if(spark, d):
    """The same with some orders not placed and a new link for every hundredth customer."""
    edges = weighted(spark, d)
    gone = edges.filter("type = 'PLACED' AND target LIKE '%7' AND source LIKE '%0'").withColumn("removed", F.lit(True))
    new = graph_of_tables(spark, d).scan("Customer").filter("c_custkey % 100 = 0").select(F.col("id").alias("source"), F.lit("S:1").alias("target"), F.lit("ALLIED").alias("type"), F.lit(0.5).alias("weight"), F.lit(0.0).alias("decay"), F.lit(False).alias("removed"))
    found = paths.what_if(edges, gone.unionByName(new), sources(spark, d))
    return found.select("start", "id", F.round("before", 3).alias("before"), F.round("after", 3).alias("after"))


LINKS = """l AS (SELECT 'R:' || n_regionkey AS source, 'N:' || n_nationkey AS target, 0.9::DOUBLE AS weight, false AS peer FROM nation UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 0.8, false FROM supplier
 UNION ALL SELECT 'N:' || n_nationkey, 'N:' || (n_nationkey + 1), 0.6, true FROM nation WHERE n_nationkey < 24),
 e AS (SELECT source, target, '0 downstream' AS type, weight * 1.0::DOUBLE AS weight, 0.0::DOUBLE AS decay FROM l WHERE NOT peer UNION ALL SELECT target, source, '1 upstream', weight * 0.5::DOUBLE, 0.0 FROM l WHERE NOT peer
 UNION ALL SELECT source, target, '2 lateral', weight * 0.7::DOUBLE, 0.0 FROM l WHERE peer UNION ALL SELECT target, source, '2 lateral', weight * 0.7::DOUBLE, 0.0 FROM l WHERE peer)"""
SPREAD = _impact_sql("e", "", 4, "SELECT 'S:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 50 = 0")


@q("signal_spread", f"WITH {LINKS}, {SPREAD} SELECT start, id, round(s, 6) AS weight, hops, array_to_string(path, '>') AS path FROM found", "G18")
def signal_spread(spark, d):
    """A signal of a supplier: up to its nation and region, across to the nations beside it, and down again."""
    g = graph_of_tables(spark, d)
    down = g.all_edges(["IN_REGION", "BASED_IN"]).select(F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("type") == "IN_REGION", 0.9).otherwise(0.8).alias("weight"), F.lit(False).alias("lateral"))
    nations = g.scan("Nation")
    beside = nations.filter("n_nationkey < 24").select(F.col("id").alias("source"), F.concat(F.lit("N:"), F.col("n_nationkey") + 1).alias("target"), F.lit(0.6).alias("weight"), F.lit(True).alias("lateral"))
    found = paths.spread(down.unionByName(beside), g.scan("Supplier").filter("s_suppkey % 50 = 0"), 4)
    return found.select("start", "id", F.round("weight", 6).alias("weight"), "hops", F.array_join("path", ">").alias("path"))


LINEAGE = """WITH s AS (SELECT 'S:' || s_suppkey AS start, s_suppkey AS k, s_nationkey AS n FROM supplier WHERE s_suppkey % 50 = 0)
SELECT start, 0 AS step, 0 AS depth, start AS id FROM s UNION ALL SELECT start, 1, 1, 'N:' || n FROM s UNION ALL SELECT start, 2, 2, 'R:' || n_regionkey FROM s JOIN nation ON n_nationkey = n"""


@q("lineage_trace", LINEAGE, "G20 G17")
def lineage_trace(spark, d):
    """From each start along its edges, in the order of a queue."""
    g = graph_of_tables(spark, d)
    starts = g.scan("Supplier").filter("s_suppkey % 50 = 0").select("id")
    return paths.lineage(g.all_edges(["BASED_IN", "IN_REGION"]), starts).select("start", "step", "depth", "id")


TRAILS = """WITH a AS (SELECT 'S:' || s_suppkey AS s, 'N:' || s_nationkey AS n, 'R:' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT x.s AS start, x.r AS id, 2 AS distance, x.s || '>' || x.n || '>' || x.r AS path FROM a x WHERE x.s = 'S:3'
UNION ALL SELECT x.s, y.s, 2, x.s || '>' || x.n || '>' || y.s FROM a x JOIN a y ON x.n = y.n AND x.s <> y.s WHERE x.s = 'S:3'
UNION ALL SELECT x.s, 'N:' || n_nationkey, 3, x.s || '>' || x.n || '>' || x.r || '>N:' || n_nationkey FROM a x JOIN nation ON 'R:' || n_regionkey = x.r AND 'N:' || n_nationkey <> x.n WHERE x.s = 'S:3')
SELECT * FROM t"""


@q("trails_by_strategy", TRAILS, "G15")
def trails_by_strategy(spark, d):
    """Every way of two or three edges from one supplier, along edges in both directions, none twice."""
    return Session(spark, graph_of_tables(spark, d)).run("TRAVERSE FROM Supplier WHERE s_suppkey = 3 VIA (BASED_IN, IN_REGION) BOTH MIN DEPTH 2 MAX DEPTH 3 STRATEGY DFS RETURN start, id, distance, path")


@q("match_from_the_far_side", "SELECT 'C:' || c_custkey AS customer, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' OR r_regionkey = 4", "G15 J2")
def match_from_the_far_side(spark, d):
    """A quantified pattern whose end is bounded grows from there: from two regions, not from all customers."""
    session = Session(spark, graph_of_tables(spark, d))
    return session.run("MATCH (c:Customer)-[LIVES_IN]->(n:Nation)-[IN_REGION{1,2}]->(r:Region) WHERE (r.r_name = 'ASIA' OR r.r_regionkey = 4) RETURN c.id AS customer, n.name AS nation")


@q("match_plus", "WITH RECURSIVE w(s, t, n) AS (SELECT turn, turn + 1, 1 FROM conversations a WHERE conv_id = 7 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = 7 AND b.turn = a.turn + 1) UNION ALL SELECT s, t + 1, n + 1 FROM w WHERE n < 5 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = 7 AND b.turn = t + 1)) SELECT 'T:7:' || s AS a, 'T:7:' || t AS b FROM w", "G15")
def match_plus(spark, d):
    """One or more links between the turns of a conversation, from its turns only."""
    return Session(spark, graph_of_tables(spark, d)).run("MATCH (a:Turn)-[NEXT+]->(b:Turn) WHERE a.conv_id = 7 RETURN a.id AS a, b.id AS b")


@q("budgeted_walk", None, "G16")
def budgeted_walk(spark, d):
    """From each start: what two hops in both directions take into a budget of 400, with weights by type of edge."""
    g = graph_of_tables(spark, d)
    names = [(label, g.scan(label).select("id", "name")) for label in ("Region", "Nation", "Supplier", "Customer")]
    nodes = reduce(lambda a, b: a.unionByName(b), [df.select("id", F.lit(label).alias("label"), F.greatest(F.lit(1), F.floor(F.length("name") / 4)).alias("cost")) for label, df in names])
    edges = g.all_edges(["BASED_IN", "LIVES_IN", "IN_REGION"]).select("source", "target", "type")
    both = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "type"))
    suppliers = g.scan("Supplier")
    seeds = suppliers.filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("query_id"), "id", F.lit(1).alias("place"))
    return paths.budgeted(both, nodes, seeds, 2, 400, {"BASED_IN": 0.9, "IN_REGION": 0.4}, ["Region"])
