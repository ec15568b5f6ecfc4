"""Connected components by alternating large-star and small-star rounds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import written

#: Each round at least halves the depth of the trees, so this is far beyond any real need.
MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Points the larger (all) neighbours of a node, itself included, at its smallest neighbour."""
    if large:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = near.filter("a <> b").distinct()
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    least = written(least, "least")  # both sides of the join get exchanges that AQE can split
    near = written(near, "near")
    if large:
        out = near.join(least, near.a == least.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.join(least, near.a == least.n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, root), root the smallest node that can be reached.

    Nodes without links to others, null ends included, don't appear. State is a table of links, never
    larger than the input plus one row a node; nothing but two numbers a round comes to the driver.
    """
    state = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        state = written(_star(written(_star(state, True), "large"), False), "small")
        new = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
