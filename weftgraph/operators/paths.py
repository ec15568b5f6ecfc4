"""Paths: first visits in the order of a queue, what a signal reaches and what would change, trails and quantified patterns.

All state is by start: rows (start, id, ..) that begin at the given starts only, with the path so far in the row. `queue` is the
place of a row in the breadth-first queue: the types and ends of its edges, compared from the first edge on, which is the order
in which a queue would give them if each node's edges are taken by type and end. Rounds are cut off from their lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.operators.lineage import cut
from weftgraph.operators.traverse import directed


#: Nodes up to which a frontier's ids are broadcast, so that only their edges are shuffled.
SMALL = 200_000


def _mark(type: str = "type", target: str = "target") -> Column:
    return F.concat_ws("|", type, target)


def first_visits(edges: DataFrame, starts: DataFrame, hops: int, strength: Column | None = None, least: float = 0.0) -> DataFrame:
    """(start, id, distance, strength, path, types, queue): each node that a start reaches, as a queue first comes to it.

    edges: source, target, type and what `strength` needs, a factor for each edge; starts: id and, where there is a factor,
    strength. What falls below `least` isn't queued. A node has the path and strength of its first visit, even if a later one
    were stronger; of edges at the same place of the queue the strongest counts. Where starts have a `world`, a bit, edges have
    `worlds`, bits: each world is walked by itself over its own edges, and rows have it."""
    own = ["start", "world"] if "world" in starts.columns else ["start"]
    factor = F.lit(1.0) if strength is None else strength
    e = edges.select("source", "target", "type", factor.alias("factor"), *["worlds" for _ in own[1:]]).filter("source <> target")
    begin = F.lit(1.0) if "strength" not in starts.columns else F.col("strength").cast("double")
    found = frontier = cut(
        starts.select(F.col("id").alias("start"), *own[1:], "id", begin.alias("strength")).groupBy(*own, "id").agg(F.max("strength").alias("strength"))
        .select(*own, "id", F.lit(0).alias("distance"), "strength", F.array("id").alias("path"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("queue"))
    )
    seen = cut(found.select(*own, "id"))
    for d in range(1, hops + 1):
        at = frontier.select(F.col("id").alias("source")).distinct()
        near = e.join(F.broadcast(at), "source", "left_semi") if at.limit(SMALL + 1).count() <= SMALL else e
        step = frontier.join(near, frontier["id"] == near["source"]).withColumn("strength", F.col("strength") * F.col("factor")).filter(F.col("strength") >= least)
        if own[1:]:
            step = step.filter(F.col("worlds").bitwiseAND(F.col("world")) != 0)
        here = F.struct(
            F.array_append("queue", _mark()).alias("queue"), (-F.col("strength")).alias("weakness"), F.array_append("path", F.col("target")).alias("path"),
            F.array_append("types", F.col("type")).alias("types"),
        )
        first = step.groupBy(*own, F.col("target").alias("id")).agg(F.min(here).alias("v"))
        frontier = cut(first.join(seen, [*own, "id"], "left_anti").select(*own, "id", F.lit(d).alias("distance"), (-F.col("v.weakness")).alias("strength"), "v.path", "v.types", "v.queue"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        seen = seen.unionByName(frontier.select(*own, "id"))
    return found.filter("distance > 0")


def impact(edges: DataFrame, sources: DataFrame, hops: int = 3, least: float = 0.1) -> DataFrame:
    """(start, id, strength, hops, path, types): where a signal goes. sources: id, value; edges: source, target, type, weight and
    decay. Strength is the value without its sign, times weight times 1 - decay of each edge, to four places."""
    starts = sources.select("id", F.abs("value").alias("strength"))
    found = first_visits(edges, starts, hops, F.col("weight") * (1 - F.col("decay")), least)
    return found.select("start", "id", F.round("strength", 4).alias("strength"), F.col("distance").alias("hops"), "path", "types")


# What a signal keeps of its weight along a link, against it, and between peers.
DIRECTIONS = {"downstream": 1.0, "upstream": 0.5, "lateral": 0.7}


def spread(links: DataFrame, starts: DataFrame, hops: int = 5, least: float = 0.1, directions: tuple[str, ...] = tuple(DIRECTIONS)) -> DataFrame:
    """(start, id, weight, hops, direction, path): how a signal spreads from starts.id. links: source (above), target (below), weight
    and lateral, whether the two are peers. A node's neighbours below are taken first, then those above, then its peers."""
    parts = []
    for n, name in enumerate(DIRECTIONS):
        if name in directions:
            some = links.filter(F.col("lateral") == (name == "lateral"))
            both = [("target", "source")] if name == "upstream" else [("source", "target")] + ([("target", "source")] if name == "lateral" else [])
            parts += [some.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(f"{n} {name}").alias("type"), (F.col("weight") * DIRECTIONS[name]).alias("weight")) for a, b in both]
    found = first_visits(reduce(DataFrame.unionByName, parts), starts.select("id"), hops, F.col("weight"), least)
    return found.select("start", "id", F.col("strength").alias("weight"), F.col("distance").alias("hops"), F.substring(F.element_at("types", -1), 3, 10).alias("direction"), "path")


def overlaid(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The edges as they would be: changed has source, target, type, weight, decay and `removed`; new edges are added."""
    key = ["source", "target", "type"]
    kept = edges.join(F.broadcast(changed.select(*key)) if changed.limit(100_001).count() <= 100_000 else changed.select(*key), key, "left_anti")
    return kept.select(*key, "weight", "decay").unionByName(changed.filter("NOT coalesce(removed, false)").select(*key, "weight", "decay"))


def what_if(edges: DataFrame, changed: DataFrame, sources: DataFrame, hops: int = 3, least: float = 0.1) -> DataFrame:
    """(start, id, before, after, change): what a signal would reach otherwise with some edges changed; equal strengths are left out.

    The edges as they are and as `overlaid` has them are walked side by side as two worlds, so that those in both are shuffled once."""
    key = ["source", "target", "type"]
    touched = changed.select(*key).distinct().withColumn("touched", F.lit(True))
    touched = F.broadcast(touched) if changed.limit(100_001).count() <= 100_000 else touched
    as_is = edges.join(touched, key, "left").select(*key, "weight", "decay", F.when(F.col("touched"), 1).otherwise(3).alias("worlds"))
    new = changed.filter("NOT coalesce(removed, false)").select(*key, "weight", "decay", F.lit(2).alias("worlds"))
    starts = sources.select("id", F.abs("value").alias("strength"), F.explode(F.array(F.lit(1), F.lit(2))).alias("world"))
    found = first_visits(as_is.unionByName(new), starts, hops, F.col("weight") * (1 - F.col("decay")), least)
    of = lambda world: F.coalesce(F.max(F.when(F.col("world") == world, F.round("strength", 4))), F.lit(0.0))
    both = found.groupBy("start", "id").agg(of(1).alias("before"), of(2).alias("after"))
    return both.withColumn("change", F.round(F.col("after") - F.col("before"), 4)).filter("change <> 0")


def named_in(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, id): the node whose name a text holds, the longest of them, then the smallest id. nodes: id, name.

    Names meet texts by their first word, so no text is compared with all names."""
    words = F.split(F.lower("text"), r"\W+")
    t = texts.select("text_id", F.lower("text").alias("text"), F.explode(F.array_distinct(words)).alias("word"))
    n = nodes.select("id", F.lower(F.trim("name")).alias("name")).filter("name <> ''").withColumn("word", F.split("name", r"\W+")[0])
    hit = t.join(n, "word").filter(F.contains("text", "name"))
    return hit.groupBy("text_id").agg(F.min_by("id", F.struct(-F.length("name"), "id")).alias("id"))


# The weight of an edge type that has none of its own, and labels that a walk passes over.
EDGE_WEIGHT = 0.5
SKIPPED = ["VectorIndex", "BM25Index", "Session", "ContextRef", "ExperimentRun", "AgentAction", "AgentThought", "SyncRun", "ContextMeta", "ContextIntelligence"]


def budgeted(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int, budget: int, weights: dict[str, float] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(query_id, place, id, distance, via, score): the seeds of each query and what a walk from them takes into a budget.

    edges: source, target, type; nodes: id, label, cost (whole, 1 at least); seeds: query_id, id, place. A hop takes the neighbours in
    the order of the nodes that they come from, then of type and id; one that doesn't fit is passed over, and only those that were
    taken are walked on from. Of a query's neighbours of one cost only as many as could fit are looked at, and of a node's only as many
    as could fit beside all that a query has already, so that a node of many edges doesn't meet each query with all of them."""
    left = W.partitionBy("query_id")
    start = seeds.select("query_id", "id", "place").join(nodes.select("id", "cost"), "id", "left").fillna(0, ["cost"])
    found = cut(start.select("query_id", F.row_number().over(left.orderBy("place", "id")).cast("long").alias("place"), "id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via"), F.lit(1.0).alias("score"), F.col("cost").cast("long").alias("cost")))
    kept = nodes.filter(~F.coalesce(F.col("label").isin(SKIPPED if skip is None else skip), F.lit(False))).select("id", F.greatest(F.lit(1), F.col("cost")).cast("long").alias("cost"))
    known = F.create_map(*[F.lit(x) for pair in (weights or {"": EDGE_WEIGHT}).items() for x in pair])
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    columns = found.columns

    def choose(key, rows):
        """Takes the rows that fit, in order."""
        rows = rows.sort_values(["from_place", "via", "id"])
        room, taken = int(rows["room"].iloc[0]), []
        for n, cost in enumerate(rows["cost"]):
            if cost <= room:
                room -= cost
                taken.append(n)
        out = rows.iloc[taken].copy()
        out["place"] = out["last"] + range(1, len(taken) + 1)
        return out[columns]

    priced = edges.groupBy("source", "target").agg(F.min(F.struct("type"))["type"].alias("type")).join(kept.withColumnRenamed("id", "target"), "target")
    priced = priced.withColumn("nth", F.row_number().over(W.partitionBy("source", "cost").orderBy("type", "target")))
    frontier = found
    for d in range(1, hops + 1):
        held = found.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]  # seeds and what fits in a budget
        near = priced.filter((F.col("nth") <= budget + held) & (F.col("nth") <= F.floor(F.lit(budget) / F.col("cost")) + held)).select("source", "target", "type")
        sums = found.groupBy("query_id").agg((F.lit(budget) - F.sum("cost")).alias("room"), F.max("place").alias("last"))
        step = frontier.select("query_id", F.col("id").alias("source"), F.col("place").alias("from_place")).join(near, "source")
        step = step.groupBy("query_id", F.col("target").alias("id")).agg(F.min(F.struct("from_place", "type")).alias("m")).join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        step = step.join(kept, "id").join(sums, "query_id").filter(F.col("cost") <= F.col("room"))
        step = step.select("query_id", "id", "cost", "room", "last", "m.from_place", F.col("m.type").alias("via"))
        nth = F.row_number().over(W.partitionBy("query_id", "cost").orderBy("from_place", "via", "id"))
        step = step.withColumn("nth", nth).filter(F.col("nth") * F.col("cost") <= F.col("room")).drop("nth")
        step = step.withColumns({"distance": F.lit(d), "score": F.coalesce(F.try_element_at(known, F.col("via")), F.lit(EDGE_WEIGHT)), "place": F.col("last")})
        frontier = cut(step.groupBy("query_id").applyInPandas(choose, kind))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found.drop("cost")


def lineage(edges: DataFrame, starts: DataFrame, hops: int = 20) -> DataFrame:
    """(start, step, depth, id, path): what a node derives from, in the order in which a queue comes to it; step 0 is the node."""
    found = first_visits(edges, starts, hops).select("start", "id", F.col("distance").alias("depth"), "path", "queue")
    own = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.array().cast("array<string>").alias("queue")).distinct()
    place = W.partitionBy("start").orderBy("depth", "queue")
    return own.unionByName(found).withColumn("step", F.row_number().over(place) - 1).select("start", "step", "depth", "id", "path")


def trails(edges: DataFrame, starts: DataFrame, least: int, most: int, direction: str = "out") -> DataFrame:
    """(start, id, length, path, types): all ways from the starts that use no edge twice, of `least` to `most` edges.

    edges: source, target, type; equal edges are one. Their number can grow with every length; `most` bounds it."""
    key = F.concat_ws("|", "source", "type", "target")
    e = cut(directed(edges.select("source", "target", "type").distinct().withColumn("edge", key), direction).distinct())
    level = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("length"), F.array("id").alias("path"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("used")).distinct())
    found = level if least == 0 else None
    for n in range(1, most + 1):
        step = level.join(e, (level["id"] == e["source"]) & ~F.array_contains("used", F.col("edge")))
        level = cut(step.select("start", F.col("target").alias("id"), F.lit(n).alias("length"), F.array_append("path", F.col("target")).alias("path"), F.array_append("types", F.col("type")).alias("types"), F.array_append("used", F.col("edge")).alias("used")))
        if n >= least:
            found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
    found = level.limit(0) if found is None else found
    return found.drop("used")


def by_strategy(found: DataFrame, strategy: str) -> DataFrame:
    """Trails as a search would meet them: depth first along each way, or breadth first by length."""
    if strategy == "DFS":
        return found.orderBy("start", "path", "types")
    return found.orderBy("length", "start", "path", "types")


def within(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """(source, target): the pairs that a walk of `least` to `most` edges links, from the starts only; distinct."""
    e = cut(edges.select("source", "target").distinct())
    level = cut(starts.select(F.col("id").alias("start"), "id").distinct())
    found = level if least == 0 else None
    for n in range(1, most + 1):
        level = cut(level.join(e, level["id"] == e["source"]).select("start", F.col("target").alias("id")).distinct())
        if n >= least:
            found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
    found = level.limit(0) if found is None else found
    return found.distinct().select(F.col("start").alias("source"), F.col("id").alias("target"))
