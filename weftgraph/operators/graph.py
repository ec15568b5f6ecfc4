"""A property graph as DataFrames: a typed one for each node label, and one for each edge type."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import table


@dataclass(frozen=True)
class Edges:
    """source and target are node ids, weight a double; other columns are properties."""

    df: DataFrame
    start: str
    end: str


class Lazy(Mapping):
    """name -> value, made when it is first asked for: a statement opens only the tables that it needs."""

    def __init__(self, makers: Mapping[str, Callable]):
        self.makers, self.made = dict(makers), {}

    @staticmethod
    def with_one(old: Mapping, name: str, value) -> Lazy:
        makers = old.makers if isinstance(old, Lazy) else {k: lambda v=v: v for k, v in old.items()}
        new = Lazy({**makers, name: lambda: value})
        new.made = {k: v for k, v in old.made.items() if k != name} if isinstance(old, Lazy) else {}
        return new

    def __getitem__(self, name):
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self):
        return len(self.makers)


@dataclass
class PropertyGraph:
    nodes: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: Mapping[str, Edges] = field(default_factory=dict)
    #: label -> letter and number columns that its ids are made of: C:7 is the row whose column is 7.
    keys: Mapping[str, tuple[str, list[str]]] = field(default_factory=dict)

    def with_nodes(self, label: str, df: DataFrame) -> PropertyGraph:
        return replace(self, nodes=Lazy.with_one(self.nodes, label, df), keys={k: v for k, v in self.keys.items() if k != label})

    def by_id(self, id: str) -> DataFrame:
        """(id, label, name) of the nodes with an id. Where ids are made of number columns, one label is read, and the filter is
        on its columns, so that it reaches the scan."""
        letter, *numbers = id.split(":")
        parts = []
        for label in self.nodes:
            if label not in self.keys:
                test = F.col("id") == id
            elif self.keys[label][0] == letter and len(numbers) == len(self.keys[label][1]) and all(n.isdecimal() and len(n) < 19 for n in numbers):
                test = reduce(lambda a, b: a & b, [F.col(c) == int(n) for c, n in zip(self.keys[label][1], numbers, strict=True)]) & (F.col("id") == id)
            else:
                continue
            df = self.nodes[label].filter(test)
            parts.append(df.select("id", F.lit(label).alias("label"), F.col("name").cast("string").alias("name")))
        return reduce(DataFrame.unionByName, parts) if parts else self.all_nodes().limit(0)

    def with_edges(self, kind: str, edges: Edges) -> PropertyGraph:
        return replace(self, edges=Lazy.with_one(self.edges, kind, edges))

    def scan(self, label: str) -> DataFrame:
        if label not in self.nodes:
            raise KeyError(f"no node label {label}")
        return self.nodes[label]

    def all_nodes(self) -> DataFrame:
        """(id, label, name) of every node."""
        parts = [df.select("id", F.lit(label).alias("label"), F.col("name").cast("string").alias("name")) for label, df in self.nodes.items()]
        return reduce(DataFrame.unionByName, parts)

    def all_edges(self, kinds: list[str] | None = None) -> DataFrame:
        """(source, target, type, weight) of the kinds, or of all."""
        chosen = kinds or list(self.edges)
        missing = [k for k in chosen if k not in self.edges]
        if missing:
            raise KeyError(f"no edge type {missing[0]}")
        parts = [self.edges[k].df.select("source", "target", F.lit(k).alias("type"), F.col("weight").cast("double").alias("weight")) for k in chosen]
        return reduce(DataFrame.unionByName, parts)

    def edges_with_names(self, kinds: list[str] | None = None) -> DataFrame:
        """Edges with display names: name, else label, else id."""
        names = self.all_nodes().select(F.col("id").alias("_id"), F.coalesce("name", "label").alias("_name"))
        out = self.all_edges(kinds)
        for side in ("source", "target"):
            out = out.join(names, out[side] == names["_id"], "left").withColumn(f"{side}_name", F.coalesce("_name", side)).drop("_id", "_name")
        return out

    def degrees(self, kinds: list[str] | None = None) -> DataFrame:
        """(id, out_degree, in_degree, degree) of nodes with edges."""
        e = self.all_edges(kinds)
        ends = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("target", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))

    def induced(self, kept: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        """Edges both of whose ends are among kept.id."""
        ids = kept.select("id")
        e = self.all_edges(kinds)
        return e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


KEYS = {
    "Region": ("region", "R", ["r_regionkey"], "r_name"), "Nation": ("nation", "N", ["n_nationkey"], "n_name"),
    "Customer": ("customer", "C", ["c_custkey"], "c_name"), "Supplier": ("supplier", "S", ["s_suppkey"], "s_name"),
    "Part": ("part", "P", ["p_partkey"], "p_name"), "Order": ("orders", "O", ["o_orderkey"], None),
    "Document": ("documents", "D", ["doc_id"], None), "Turn": ("conversations", "T", ["conv_id", "turn"], "role"),
}


def node_id(letter: str, *keys: str):
    return F.concat_ws(":", F.lit(letter), *[F.col(k).cast("string") for k in keys])


def graph_of_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The tables as a graph; nothing is read until a statement needs it."""
    opened = Lazy({name: lambda name=name: table(spark, sf_dir, name) for name in [*(k[0] for k in KEYS.values()), "lineitem"]})

    def labelled(name, letter, keys, shown):
        ident = node_id(letter, *keys)
        return opened[name].select(ident.alias("id"), (F.col(shown) if shown else ident).alias("name"), "*")

    def link(df, start, end, source, target, weight=None):
        w = F.lit(1.0) if weight is None else F.col(weight)
        return Edges(df.select(node_id(*source).alias("source"), node_id(*target).alias("target"), w.alias("weight")), start, end)

    def supplies():
        pairs = opened["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
        return link(pairs, "Supplier", "Part", ("S", "l_suppkey"), ("P", "l_partkey"), "weight")

    def following():
        after = opened["conversations"].selectExpr("conv_id", "turn", "lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn").filter("next_turn IS NOT NULL")
        return link(after, "Turn", "Turn", ("T", "conv_id", "turn"), ("T", "conv_id", "next_turn"))

    edges = {
        "IN_REGION": lambda: link(opened["nation"], "Nation", "Region", ("N", "n_nationkey"), ("R", "n_regionkey")),
        "LIVES_IN": lambda: link(opened["customer"], "Customer", "Nation", ("C", "c_custkey"), ("N", "c_nationkey")),
        "BASED_IN": lambda: link(opened["supplier"], "Supplier", "Nation", ("S", "s_suppkey"), ("N", "s_nationkey")),
        "PLACED": lambda: link(opened["orders"], "Customer", "Order", ("C", "o_custkey"), ("O", "o_orderkey")),
        "CONTAINS": lambda: link(opened["lineitem"], "Order", "Part", ("O", "l_orderkey"), ("P", "l_partkey"), "l_quantity"),
        "SHIPPED_BY": lambda: link(opened["lineitem"], "Order", "Supplier", ("O", "l_orderkey"), ("S", "l_suppkey")),
        "SUPPLIES": supplies,
        "NEXT": following,
    }
    return PropertyGraph(Lazy({label: lambda k=k: labelled(*k) for label, k in KEYS.items()}), Lazy(edges), {label: (k[1], k[2]) for label, k in KEYS.items()})
