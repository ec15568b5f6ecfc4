"""Versions, snapshots, differences, and writes as new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.operators.graph import Edges, PropertyGraph


def numbered(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """Adds version (1, 2, ...) by order within an entity."""
    return df.withColumn("version", F.row_number().over(W.partitionBy(entity).orderBy(*order)))


def intervals(df: DataFrame, entity: str, ts: str, *tie: str) -> DataFrame:
    """Adds valid_from and valid_to, the time of the next version (null for the last)."""
    order = W.partitionBy(entity).orderBy(ts, *tie)
    return df.withColumns({"valid_from": F.col(ts), "valid_to": F.lead(ts).over(order)})


def system_time(df: DataFrame, kind: str, *when) -> DataFrame:
    """Rows of [valid_from, valid_to) for TIMESTAMP t, FROM a TO b, BETWEEN a AND b, CONTAINED IN (a, b), ALL."""
    start, end = F.col("valid_from"), F.col("valid_to")
    t = [F.lit(w).cast("timestamp") for w in when]
    if kind == "ALL":
        return df
    if kind in ("TIMESTAMP", "COMMIT", "RUN"):
        return df.filter((start <= t[0]) & (end.isNull() | (end > t[0])))
    if kind == "FROM":
        return df.filter((start < t[1]) & (end.isNull() | (end > t[0])))
    if kind == "BETWEEN":
        return df.filter((start <= t[1]) & (end.isNull() | (end > t[0])))
    return df.filter((start >= t[0]) & (end <= t[1]))


def as_of(df: DataFrame, entity: str, ts: str, t, *tie: str) -> DataFrame:
    """The last row of each entity at or before t: a maximum, so nothing is sorted."""
    kept = df.filter(F.col(ts) <= t)
    last = kept.groupBy(entity).agg(F.max_by(F.struct(*kept.columns), F.struct(ts, *tie)).alias("_r"))
    return last.select("_r.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, value: str, out: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time, by one union and one window."""
    a = left.select("*", F.col(lts).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_s"))
    b = right.select(F.col(key), F.col(rts).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_s"))
    order = W.partitionBy(key).orderBy("_t", "_s").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(order)).filter("_s = 1").drop("_t", "_v", "_s")


def diff(df: DataFrame, a, b) -> DataFrame:
    """(id, change) between two times of a table with valid_from and valid_to: added, removed, modified."""
    one, two = system_time(df, "TIMESTAMP", a), system_time(df, "TIMESTAMP", b)
    x = one.select(F.col("id").alias("i"), F.col("valid_from").alias("f"))
    y = two.select(F.col("id"), F.col("valid_from"))
    both = x.join(y, x["i"] == y["id"], "full_outer")
    change = F.when(F.col("i").isNull(), "added").when(F.col("id").isNull(), "removed").when(F.col("f") != F.col("valid_from"), "modified")
    return both.select(F.coalesce("id", "i").alias("id"), change.alias("change")).filter("change IS NOT NULL")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, change, <metric>_delta): full outer join of two states."""
    o = old.select(F.col(key).alias("_k"), *[F.col(m).alias(f"_{m}") for m in metrics])
    both = new.join(o, new[key] == o["_k"], "full_outer")
    same = F.lit(True)
    for m in metrics:
        same = same & F.col(m).eqNullSafe(F.col(f"_{m}"))
    change = F.when(F.col("_k").isNull(), "added").when(F.col(key).isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), change.alias("change"), *[(F.coalesce(m, F.lit(0)) - F.coalesce(f"_{m}", F.lit(0))).alias(f"{m}_delta") for m in metrics])


def changed_keys(df: DataFrame, entity: str, order: str, columns: list[str]) -> DataFrame:
    """Adds changed: the names of columns that differ from the version before, comma-joined."""
    near = W.partitionBy(entity).orderBy(order)
    first = F.lag(F.lit(1)).over(near).isNull()
    names = [F.when(~first & ~F.col(c).eqNullSafe(F.lag(c).over(near)), c) for c in columns]
    return df.withColumn("changed", F.concat_ws(",", *names))


def updated(df: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """Sets the values where hit, and counts `version` up where the table has one."""
    new = {k: F.when(hit, v).otherwise(df[k] if k in df.columns else F.lit(None)) for k, v in values.items()}
    if "version" in df.columns and "version" not in new:
        new["version"] = F.when(hit, df["version"] + 1).otherwise(df["version"])
    return df.withColumns(new)


def checked_update(df: DataFrame, hit: Column, expected: int, values: dict[str, Column]) -> DataFrame:
    """updated(), if all rows hit have the expected version."""
    if not df.filter(hit & (F.col("version") != expected)).isEmpty():
        raise ValueError("version conflict")
    return updated(df, hit, values)


def without_nodes(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Edges at either end of the ids go."""
    gone = ids.select(F.col("id").alias("_gone"))
    for kind, e in graph.edges.items():
        kept = e.df.join(gone, e.df["source"] == gone["_gone"], "left_anti")
        graph = graph.with_edges(kind, Edges(kept.join(gone, kept["target"] == gone["_gone"], "left_anti"), e.start, e.end))
    return graph


def bulk_merge(old: DataFrame, new: DataFrame, key: str = "id", counts: str = "mention_count") -> DataFrame:
    """Upsert: new values win where they aren't null, counts add up."""
    n = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    both = old.join(n, old[key] == n[f"_{key}"], "full_outer")
    merged = [
        (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) if c == counts else F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c)
        for c in old.columns
    ]
    return both.select(*merged)


def by_policy(old: DataFrame, new: DataFrame, key: str, policy: str = "latest_wins") -> DataFrame:
    """Duplicates by keep_both, merge_properties (old wins, gaps filled) or latest_wins."""
    if policy == "keep_both":
        return old.unionByName(new, allowMissingColumns=True)
    a, b = (new, old) if policy == "latest_wins" else (old, new)
    b = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])
    both = a.join(b, a[key] == b[f"_{key}"], "full_outer")
    if policy == "latest_wins":  # a row is taken whole
        return both.select(*[F.when(a[key].isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in old.columns])
    return both.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in old.columns])


def merge_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends replaced by mapping (id, survivor); loops go, equal edges become one."""
    out = edges
    for side in ("source", "target"):
        m = mapping.select(F.col("id").alias("_id"), F.col("survivor").alias("_s"))
        out = out.join(m, out[side] == m["_id"], "left").withColumn(side, F.coalesce("_s", side)).drop("_id", "_s")
    return out.filter("source <> target").groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def stale_flags(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Adds stale: an edge leads here from a changed node."""
    hit = edges.join(changed.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("_t")).distinct()
    return nodes.join(hit, nodes["id"] == hit["_t"], "left").withColumn("stale", F.col("_t").isNotNull()).drop("_t")


def violations(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def save_checkpoint(df: DataFrame, root: str, name: str) -> str:
    """A named state of a table as a directory of its own."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def restore_checkpoint(spark, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def restore_version(versions: DataFrame, entity: str, number: str, wanted: int) -> DataFrame:
    """The history with the wanted version of each entity appended as its newest one; entities without it stay as they are."""
    last = versions.groupBy(F.col(entity).alias("_e")).agg((F.max(number) + 1).alias("_n"))
    again = versions.filter(F.col(number) == wanted).join(last, F.col(entity) == F.col("_e")).withColumn(number, F.col("_n")).drop("_e", "_n")
    return versions.unionByName(again)


def expired(edges: DataFrame, label: str, at: str, days: int, now) -> DataFrame:
    """The edges without those of a label that were computed more than so many days before now; undated ones stay."""
    old = (F.col("label") == label) & (F.col(at) < now - F.expr(f"INTERVAL {days} DAYS"))
    return edges.filter(~F.coalesce(old, F.lit(False)))


def indicator_over_time(values: DataFrame, name: Column, wanted: str, at: str, since) -> DataFrame:
    """Rows from an instant on whose indicator's name holds the wanted one in any case, with their date."""
    return values.filter(F.lower(name).contains(wanted.lower()) & (F.col(at) >= since)).withColumn("date", F.to_date(at))


def of_domain(nodes: DataFrame, domain: str) -> DataFrame:
    """Nodes of a domain, read from the first of domain, _domain and _schema that they have."""
    held = [c for c in ("domain", "_domain", "_schema") if c in nodes.columns]
    return nodes.filter(F.coalesce(*held) == domain) if held else nodes.limit(0)
