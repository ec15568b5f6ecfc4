"""Traversal and iterative graph algorithms over (source, target, weight) edges.

Loops keep a frontier and cut its lineage each round; they end when the frontier is empty. State is one row
a node (a path: one row a node and start), never a list of all paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.operators.lineage import cut


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(source, target, ...) in the direction of travel: out, in, or both."""
    if direction == "out":
        return edges
    swapped = {"source": "target", "target": "source"}
    back = edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in edges.columns])
    return back if direction == "in" else edges.unionByName(back)


def neighbors(edges: DataFrame, starts: DataFrame, direction: str = "out") -> DataFrame:
    """(source, target) pairs for the nodes of starts.id, distinct."""
    e = directed(edges.select("source", "target"), direction)
    return e.join(starts.select(F.col("id").alias("source")), "source", "left_semi").distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(start, id, distance) of nodes within depth of each start; a start isn't its own result."""
    e = directed(edges.select("source", "target"), direction).distinct()
    found = frontier = cut(starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("distance")).distinct())
    for d in range(1, depth + 1):
        step = frontier.join(e, frontier["id"] == e["source"]).select("start", F.col("target").alias("id")).distinct()
        frontier = cut(step.join(found.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(d).alias("distance")))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found.filter("distance > 0")


def reachable(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", least: int = 1) -> DataFrame:
    """(id, distance): the smallest distance from any start. One row a node, whatever the number of starts."""
    e = directed(edges.select("source", "target"), direction).distinct()
    found = frontier = cut(starts.select("id", F.lit(0).alias("distance")).distinct())
    for d in range(1, depth + 1):
        step = frontier.join(e, frontier["id"] == e["source"]).select(F.col("target").alias("id")).distinct()
        frontier = cut(step.join(found.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance")))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found.filter(F.col("distance") >= least)


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = 6) -> DataFrame:
    """(step, id) of a shortest undirected path, the one with the smallest ids; no rows if there is none.

    Keeps for each node that is reached the smallest predecessor, then walks back from the end.
    """
    e = directed(edges.select("source", "target"), "both").distinct()
    spark = edges.sparkSession
    found = frontier = cut(spark.createDataFrame([(start, None, 0)], "id string, came string, distance int"))
    for d in range(1, depth + 1):
        if not found.filter(F.col("id") == end).isEmpty():
            break
        step = frontier.select(F.col("id").alias("came")).join(e, F.col("came") == e["source"]).groupBy(F.col("target").alias("id")).agg(F.min("came").alias("came"))
        frontier = cut(step.join(found.select("id"), "id", "left_anti").select("id", "came", F.lit(d).alias("distance")))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    path, at = [], end
    while at is not None:
        row = found.filter(F.col("id") == at).first()
        if row is None:
            return spark.createDataFrame([], "step int, id string")
        path.append((row["distance"], at))
        at = row["came"]
    return spark.createDataFrame(path[::-1], "step int, id string")


def pagerank_undirected(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(id, rank): fixed rounds over the undirected adjacency sets; the mass of nodes without edges is dropped."""
    e = cut(directed(edges.select("source", "target"), "both").distinct())
    return _pagerank(e, nodes, damping, iterations, None)[0]


def pagerank_directed(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, int]:
    """(id, rank) and the rounds taken: until the sum of changes is below the tolerance."""
    return _pagerank(cut(edges.select("source", "target")), nodes, damping, most, tolerance)


def _pagerank(e: DataFrame, nodes: DataFrame, damping: float, most: int, tolerance: float | None) -> tuple[DataFrame, int]:
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    out = cut(e.groupBy("source").agg(F.count("*").alias("out")))
    rank = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(1, most + 1):
        sent = rank.join(out, rank["id"] == out["source"]).select(F.col("id").alias("source"), (F.col("rank") / F.col("out")).alias("share"))
        got = e.join(sent, "source").groupBy("target").agg(F.sum("share").alias("got"))
        new = ids.join(got, ids["id"] == got["target"], "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = cut(new)
        if tolerance is not None:
            change = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if (change or 0.0) < tolerance:
                return new, k
        rank = new
    return rank, most


def components(edges: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """(id, component): the smallest id that is connected; nodes without edges stand alone."""
    e = cut(directed(edges.select("source", "target"), "both").distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(most):
        near = e.join(label, e["source"] == label["id"]).groupBy(F.col("target").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        # a jump along labels halves the length of chains
        up = step.select(F.col("id").alias("root"), F.col("component").alias("above"))
        new = cut(step.join(up, step["component"] == up["root"], "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component"), "old"))
        label = new.select("id", "component")
        if new.filter("component <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): each round takes the label most neighbours have, the smallest of equals."""
    e = cut(directed(edges.select("source", "target"), "both").distinct())
    label = cut(nodes.select("id", F.col("id").alias("community")).distinct())
    for _ in range(rounds):
        votes = e.join(label, e["source"] == label["id"]).groupBy(F.col("target").alias("id"), "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("new"))
        label = cut(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
    return label


def propagate(edges: DataFrame, starts: DataFrame, hops: int, least: float, keep: float = 1.0) -> DataFrame:
    """(id, strength, distance): strength times edge weight times keep a hop; the first visit counts, the
    strongest of those of one hop; paths below least end. edges: source, target, weight; starts: id, strength."""
    found = frontier = cut(starts.select("id", "strength", F.lit(0).alias("distance")))
    for d in range(1, hops + 1):
        step = frontier.join(edges.select("source", "target", "weight"), frontier["id"] == F.col("source"))
        step = step.select(F.col("target").alias("id"), (F.col("strength") * F.col("weight") * keep).alias("strength")).filter(F.col("strength") >= least)
        step = step.groupBy("id").agg(F.max("strength").alias("strength"))
        frontier = cut(step.join(found.select("id"), "id", "left_anti").select("id", "strength", F.lit(d).alias("distance")))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found.filter("distance > 0")


def closeness(edges: DataFrame, nodes: DataFrame, depth: int = 10) -> DataFrame:
    """(id, closeness): reached nodes over the sum of their distances, undirected."""
    found = bfs(edges, nodes, depth, "both")
    return found.groupBy(F.col("start").alias("id")).agg((F.count("*") / F.sum("distance")).alias("closeness"))


def betweenness(edges: DataFrame, nodes: DataFrame, depth: int = 10) -> DataFrame:
    """(id, betweenness) of undirected shortest paths, each pair once: forward counts of paths a level at a
    time, then dependencies back. State is one row for each start and node."""
    e = cut(directed(edges.select("source", "target"), "both").distinct())
    level = cut(nodes.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"), F.lit(1.0).alias("paths")))
    found = level
    top = 0
    for d in range(1, depth + 1):
        step = level.join(e, level["id"] == e["source"]).groupBy("start", F.col("target").alias("id")).agg(F.sum("paths").alias("paths"))
        level = cut(step.join(found.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(d).alias("distance"), "paths"))
        if level.isEmpty():
            break
        found, top = cut(found.unionByName(level)), d
    back = None
    total = None
    for d in range(top, 0, -1):
        here = found.filter(F.col("distance") == d)
        own = here.select("start", "id", "paths", F.lit(0.0).alias("dep")) if back is None else here.join(back, ["start", "id"], "left").select("start", "id", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep"))
        own = cut(own)
        total = own.select("id", "dep") if total is None else total.unionByName(own.select("id", "dep"))
        above = found.filter(F.col("distance") == d - 1).select("start", F.col("id").alias("up"), F.col("paths").alias("up_paths"))
        pairs = own.join(e, own["id"] == e["target"]).join(above, (F.col("up") == F.col("source")) & (above["start"] == own["start"])).select(own["start"], "up", (F.col("up_paths") / F.col("paths") * (1 + F.col("dep"))).alias("dep"))
        back = cut(pairs.groupBy("start", F.col("up").alias("id")).agg(F.sum("dep").alias("dep")))
    ids = nodes.select("id").distinct()
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    sums = total.groupBy("id").agg((F.sum("dep") / 2).alias("b"))
    return ids.join(sums, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def budgeted_hops(edges: DataFrame, seeds: DataFrame, cost: DataFrame, hops: int, budget: int) -> DataFrame:
    """(id, distance) in order of (distance, id) as long as the running cost stays within budget."""
    near = reachable(edges, seeds, hops, "both", 0).join(cost, "id")
    order = W.orderBy("distance", "id").rowsBetween(W.unboundedPreceding, 0)
    near = near.orderBy("distance", "id").limit(budget)  # each costs 1 at least, so no more can fit
    return near.withColumn("spent", F.sum("cost").over(order)).filter(F.col("spent") <= budget).select("id", "distance", "spent")
