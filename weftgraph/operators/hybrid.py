"""Searches that put several signals together: an index search that goes on along edges, and a ranking by agreement.

All inputs are tables by query, so a batch of queries is one plan; a query has a few dozen candidates, whatever the corpus.
Ties are broken by id. Names count as equal by their first NAME characters, trimmed and in lower case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import text as X
from weftgraph.operators import search
from weftgraph.operators.lineage import cut

# What the combined search takes of each signal, and the scores of what isn't scored by it.
NAME, MEANINGFUL, EXPANDED, EDGES, ENTITIES, SHORT = 60, 3, 5, 10, 5, 3
NEAR, NEIGHBOURS = 3, 3
CONNECTED, SEMANTIC, FUZZY = 0.3, 0.1, 0.5
# Labels of sources, which come before others that as many signals found.
SOURCES = ["Fact", "Passage", "Document", "TextChunk", "WebPage", "Entity", "Organization", "Claim", "Statistic", "Article"]
ENTITY_LABELS = ["Entity", "Organization"]


def placed(df: DataFrame, by: list, out: str = "place", within: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds the place from 1 within a query."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*within).orderBy(*by)))


def overlapping(queries: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, name, label, score, place): the results whose stems hold enough of the query's longer stems, by how many
    of all its stems they hold; where none of a query's results do, its first ones as they are.

    found: query_id, id, name, label, snippet, score. Enough is half of the stems of more than MEANINGFUL characters, one at least."""
    q = queries.select("query_id", F.array_distinct(X.tokens(F.col("text"))).alias("stems"))
    q = q.withColumn("longer", F.filter("stems", lambda t: F.length(t) > MEANINGFUL))
    held = X.tokens(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("snippet", F.lit(""))))
    rows = found.withColumn("held", held).join(q, "query_id")
    rows = rows.withColumns({"relevance": F.size(F.array_intersect("stems", "held")), "enough": F.size(F.array_intersect("longer", "held")) >= F.greatest(F.lit(1), F.floor(F.size("longer") / 2))})
    rows = rows.withColumn("some", F.max("enough").over(W.partitionBy("query_id")))
    rows = placed(rows, [F.desc("score"), "id"], "first").filter(F.when(F.col("some"), F.col("enough")).otherwise(F.col("first") <= limit))
    return placed(rows, [F.when(F.col("some"), -F.col("relevance")).otherwise(0), F.desc("score"), "id"]).select("query_id", "id", "name", "label", "score", "place")


def combined(queries: DataFrame, nodes: DataFrame, bm25: DataFrame, edges: DataFrame, neighbours: Callable[[DataFrame], DataFrame], fuzzy: DataFrame, limit: int = 10, content_labels: list[str] | None = None) -> DataFrame:
    """(query_id, place, id, name, score, via): matches, then what the first ones are connected with, then what is near the first
    ones, then what is spelt alike; of each name the first.

    nodes: id, label, name, snippet; bm25: query_id, id, score; edges: source, target, type, taken in the order of type and
    target; neighbours(ids) gives id, near, rank for a table of ids; fuzzy: query_id, id, similarity."""
    named = nodes.select("id", "label", "name", "snippet")
    found = search.top(bm25, 3 * limit).join(named, "id")
    matches = cut(overlapping(queries, found, limit))

    first = matches.filter(F.col("place") <= EXPANDED).select("query_id", "place", F.col("id").alias("from"))
    along = placed(first.join(edges, F.col("from") == F.col("source")), ["type", "target"], "edge", ("query_id", "from")).filter(F.col("edge") <= EDGES)
    along = along.join(named.select(F.col("id").alias("target"), "name", "label"), "target").filter(F.coalesce(F.length("name"), F.lit(0)) > 0)
    entities = along.groupBy("query_id", "name").agg(F.min(F.struct("place", "edge", "target", "type")).alias("m"))
    entities = placed(entities, ["m.place", "m.edge"]).filter((F.col("place") <= ENTITIES) & (F.length("name") > SHORT))
    connected = entities.select("query_id", F.col("m.target").alias("id"), "name", F.lit(CONNECTED).alias("score"), F.concat(F.lit("connected ("), "m.type", F.lit(")")).alias("via"), F.lit(2).alias("stage"), "place")

    near = matches.filter(F.col("place") <= NEAR).select("query_id", "place", F.col("id").alias("from"))
    close = neighbours(cut(near.select(F.col("from").alias("id")).distinct())).filter(F.col("rank") <= NEIGHBOURS)
    close = near.join(close.withColumnRenamed("id", "from"), "from").join(named.select(F.col("id").alias("near"), "name", "label"), "near")
    close = close.filter(F.col("label").isin(content_labels)) if content_labels else close
    taken = matches.select("query_id", F.lower("name").alias("low")).distinct()
    close = close.withColumn("low", F.lower("name")).join(taken, ["query_id", "low"], "left_anti")
    close = close.groupBy("query_id", "low").agg(F.min(F.struct("place", "rank", "near", "name")).alias("m"))
    semantic = placed(close, ["m.place", "m.rank"]).select("query_id", F.col("m.near").alias("id"), "m.name", F.lit(SEMANTIC).alias("score"), F.lit("semantic_neighbor").alias("via"), F.lit(3).alias("stage"), "place")

    alike = search.top(fuzzy.withColumnRenamed("similarity", "score"), limit).join(named, "id")
    alike = alike.select("query_id", "id", "name", (F.col("score") * FUZZY).alias("score"), F.lit("fuzzy_match").alias("via"), F.lit(4).alias("stage"), F.col("rank").alias("place"))

    every = matches.select("query_id", "id", "name", "score", F.lit("bm25").alias("via"), F.lit(1).alias("stage"), "place")
    every = reduce(DataFrame.unionByName, [every, connected, semantic, alike])
    key = F.substring(F.lower(F.trim(F.coalesce("name", F.lit("")))), 1, NAME)
    one = every.groupBy("query_id", key.alias("key")).agg(F.min(F.struct("stage", "place", "id", "name", "score", "via")).alias("r")).select("query_id", "r.*")
    one = one.join(matches.select("query_id").distinct(), "query_id", "left_semi")  # without a match there are no results
    return placed(one.withColumnRenamed("place", "p"), ["stage", "p"]).filter(F.col("place") <= limit).select("query_id", "place", "id", "name", "score", "via")


def entity_signal(queries: DataFrame, nodes: DataFrame, edges: DataFrame, most: int, entities: int = ENTITIES) -> DataFrame:
    """(query_id, id, rank): what is linked with entities whose name holds a word of the query, in the order of entity, type, end.

    nodes: id, label, name. A word of three characters or more meets the names that have its first three."""
    word = F.lower(F.regexp_replace(F.col("w"), r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", ""))
    q = queries.select("query_id", F.explode(F.split("text", r"\s+")).alias("w")).select("query_id", word.alias("w")).filter(F.length("w") >= 3).distinct()
    names = nodes.filter(F.col("label").isin(ENTITY_LABELS)).select(F.col("id").alias("entity"), F.lower("name").alias("name"))
    parts = names.select("entity", "name", F.explode(F.array_distinct(X.trigrams(F.col("name")))).alias("gram"))
    hit = q.withColumn("gram", F.substring("w", 1, 3)).join(parts, "gram").filter(F.contains("name", "w")).select("query_id", "entity").distinct()
    hit = placed(hit, ["entity"], "n").filter(F.col("n") <= entities)
    linked = hit.join(edges, F.col("entity") == F.col("source")).groupBy("query_id", F.col("target").alias("id")).agg(F.min(F.struct("n", "type")).alias("m"))
    return placed(linked, ["m.n", "m.type", "id"], "rank").filter(F.col("rank") <= most).select("query_id", "id", "rank")


def agreed(signals: dict[str, DataFrame], labels: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, place, id, score, signals, names): by the number of signals that found a node, sources before others, then by
    the sum of 1 / (60 + rank). signals: name -> query_id, id, rank from 1; labels: id, label."""
    every = reduce(DataFrame.unionByName, [df.select("query_id", "id", "rank", F.lit(name).alias("signal")) for name, df in signals.items()])
    sums = every.groupBy("query_id", "id").agg(F.sum(1 / (search.RRF_K + F.col("rank"))).alias("score"), F.count("*").alias("signals"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("names"))
    rows = sums.join(labels.select("id", "label"), "id", "left").withColumn("other", (~F.coalesce(F.col("label").isin(SOURCES), F.lit(False))).cast("int"))
    return placed(rows.withColumn("score", F.round("score", 10)), [F.desc("signals"), "other", F.desc("score"), "id"]).filter(F.col("place") <= k).select("query_id", "place", "id", "score", "signals", "names")
