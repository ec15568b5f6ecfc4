"""Named states of a graph: saved, listed, compared, restored and deleted, each with the one it came from.

    folder/checkpoints.json     name -> number, message, parent, tables with their rows
    folder/<number>/...         a Parquet table for each label and edge type that differs from the parent's

A table whose rows the parent has as they are (by count and a sum of row hashes) isn't written again but named where it is. A
deleted checkpoint's tables stay as long as another one names them; nothing is removed from the folder but by its owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import Edges, PropertyGraph
from weftgraph.sources.logs import Folder


class Checkpoints:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.url, self.folder = spark, folder.rstrip("/"), Folder(folder)

    def _all(self) -> dict:
        return self.folder.get("checkpoints.json") or {"last": None, "next": 0, "named": {}}

    @staticmethod
    def _mark(df: DataFrame) -> list:
        """Rows and a sum of their hashes, which doesn't depend on their order."""
        columns = sorted(df.columns)
        row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first() if columns else None
        return [row["n"], row["h"], columns]

    def save(self, graph: PropertyGraph, name: str, message: str = "") -> dict:
        state = self._all()
        if name in state["named"]:
            raise FileExistsError(f"checkpoint {name} is there already")
        parent = state["named"].get(state["last"], {}).get("tables", {})
        tables = {}
        for kind, found in (("node", dict(graph.nodes.items())), ("edge", {k: e.df for k, e in graph.edges.items()})):
            for label, df in found.items():
                key, mark = f"{kind}:{label}", self._mark(df)
                if parent.get(key, {}).get("mark") == mark:
                    tables[key] = parent[key]
                    continue
                path = f"{self.url}/{state['next']}/{kind}={label}"
                df.write.parquet(path)
                ends = [graph.edges[label].start, graph.edges[label].end] if kind == "edge" else None
                tables[key] = {"path": path, "mark": mark, "ends": ends}
        entry = {"number": state["next"], "message": message, "parent": state["last"], "tables": tables}
        self.folder.put("checkpoints.json", {"last": name, "next": state["next"] + 1, "named": state["named"] | {name: entry}})
        return entry

    def list(self) -> DataFrame:
        """(number, name, message, parent, tables, rows), in the order in which they were saved."""
        rows = [(e["number"], n, e["message"], e["parent"], len(e["tables"]), sum(t["mark"][0] for t in e["tables"].values())) for n, e in self._all()["named"].items()]
        return self.spark.createDataFrame(sorted(rows), "number int, name string, message string, parent string, tables int, rows long")

    def _entry(self, name: str) -> dict:
        known = self._all()["named"]
        if name not in known:
            raise FileNotFoundError(f"no checkpoint {name}")
        return known[name]

    def restore(self, name: str) -> PropertyGraph:
        """The graph as it was; later checkpoints stay."""
        graph = PropertyGraph()
        for key, table in self._entry(name)["tables"].items():
            kind, _, label = key.partition(":")
            df = self.spark.read.parquet(table["path"])
            graph = graph.with_nodes(label, df) if kind == "node" else graph.with_edges(label, Edges(df, *table["ends"]))
        state = self._all()
        self.folder.put("checkpoints.json", state | {"last": name})  # what is saved next comes from here
        return graph

    def changed(self, old: str, new: str) -> DataFrame:
        """(table, change): tables that one checkpoint has and the other hasn't, or has otherwise."""
        a, b = self._entry(old)["tables"], self._entry(new)["tables"]
        rows = [(k, "added" if k not in a else "removed" if k not in b else "modified") for k in sorted({*a, *b}) if a.get(k, {}).get("mark") != b.get(k, {}).get("mark")]
        return self.spark.createDataFrame(rows, "table string, change string")

    def delete(self, name: str) -> None:
        """Takes a checkpoint off the list; those that came from it come from its parent then."""
        gone, state = self._entry(name), self._all()
        named = {n: (e | {"parent": gone["parent"]} if e["parent"] == name else e) for n, e in state["named"].items() if n != name}
        self.folder.put("checkpoints.json", state | {"named": named, "last": gone["parent"] if state["last"] == name else state["last"]})
