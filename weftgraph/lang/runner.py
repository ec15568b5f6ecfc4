"""Statements of the query language compiled to DataFrames.

LIMIT and OFFSET come after grouping, NULL is unequal to every value, COUNT counts rows, SUM and AVG of
nothing are 0. A comparison of a number with a quoted literal casts the literal.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.lang.kept import Kept, Materialized
from weftgraph.lang.parser import Call, Name, NodePattern, Statement, Test, Unsupported, Variable, parse
from weftgraph.operators import paths, search, traverse, versions
from weftgraph.operators.graph import Edges, PropertyGraph
from weftgraph.operators.indexes import IndexCatalogue


class Session(Kept):
    """Runs scripts over a graph; holds its namespaces, variables, views and indexes."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, name: str = "default", catalogue: IndexCatalogue | None = None):
        self.spark, self.spaces, self.active, self.catalogue = spark, {name: graph}, name, catalogue
        self.materialized: dict[str, Materialized] = {}
        self.variables: dict[str, object] = {}
        self.views: dict[str, DataFrame] = {}
        self.functions: dict[str, Statement] = {}

    @property
    def graph(self) -> PropertyGraph:
        return self.spaces[self.active]

    @graph.setter
    def graph(self, new: PropertyGraph) -> None:
        self.spaces[self.active] = new

    def run(self, text: str) -> DataFrame | str | None:
        """All statements of the text in order; the last one's result."""
        out = None
        for one in parse(text):
            out = self.execute(one)
        return out

    def execute(self, s: Statement):
        return getattr(self, f"_{s.kind}")(**s.args)

    # -- expressions -----------------------------------------------------------------------------------

    def value(self, v):
        if isinstance(v, Variable):
            if v.name not in self.variables:
                raise Unsupported(f"variable ${v.name} has no value")
            return self.variables[v.name]
        return v

    def column(self, df: DataFrame, name: Name) -> Column:
        for c in (f"{name.owner}__{name.column}", name.column) if name.owner else (name.column,):
            if c in df.columns:
                return df[c]
        # domain falls back to the names under which loaders keep it
        if name.column == "domain" and not name.owner and (some := [c for c in ("_domain", "_schema") if c in df.columns]):
            return F.coalesce(*[df[c] for c in some])
        return F.lit(None).cast("string")

    def _pair(self, df: DataFrame, left: Column, kind: T.DataType | None, value) -> tuple[Column, Column]:
        v = self.value(value)
        if isinstance(kind, T.NumericType) and isinstance(v, str):
            return left, F.lit(v).try_cast("double")
        if isinstance(kind, T.StringType) and isinstance(v, int | float) and not isinstance(v, bool):
            return left.try_cast("double"), F.lit(v)
        return left, F.lit(v)

    def predicate(self, df: DataFrame, test: Test | None, named=None) -> Column:
        """named: gives the column of an aggregate, for HAVING."""
        if test is None:
            return F.lit(True)
        if test.operator in ("AND", "OR"):
            parts = [self.predicate(df, t, named) for t in test.operands]
            return reduce(lambda a, b: a & b if test.operator == "AND" else a | b, parts)
        if test.operator == "NOT":
            return ~F.coalesce(self.predicate(df, test.operands[0], named), F.lit(False))
        what = test.operands[0]
        left = named(what) if named and isinstance(what, Call) else self.column(df, what)
        kind = df.select(left).schema[0].dataType
        if test.operator == "IS NULL":
            return left.isNull()
        if test.operator in ("IN", "NOT IN"):
            inside = left.isin([self.value(v) for v in test.operands[1]])
            return inside if test.operator == "IN" else ~F.coalesce(inside, F.lit(False))
        a, b = self._pair(df, left, kind, test.operands[1])
        text = left.cast("string")
        return {
            "=": lambda: a == b,
            "!=": lambda: ~a.eqNullSafe(b),
            "<": lambda: a < b,
            "<=": lambda: a <= b,
            ">": lambda: a > b,
            ">=": lambda: a >= b,
            "CONTAINS": lambda: F.lower(text).contains(str(self.value(test.operands[1])).lower()),
            "STARTS": lambda: text.startswith(str(self.value(test.operands[1]))),
            "ENDS": lambda: text.endswith(str(self.value(test.operands[1]))),
            "SIMILAR": lambda: text.rlike(str(self.value(test.operands[1]))),
            "BETWEEN": lambda: a.between(b, self._pair(df, left, kind, test.operands[2])[1]),
        }[test.operator]()

    def aggregate(self, df: DataFrame, call: Call) -> Column:
        f = call.function
        if f == "COUNT":
            if call.argument is None or call.modifier in ("NODE", "EDGE"):
                return F.count(F.lit(1))
            c = self.column(df, call.argument)
            return F.count_distinct(c) if call.modifier == "DISTINCT" else F.count(c)
        c = self.column(df, call.argument)
        text = c.cast("string")
        return {
            "SUM": lambda: F.coalesce(F.sum(c.try_cast("double")), F.lit(0.0)),
            "AVG": lambda: F.coalesce(F.avg(c.try_cast("double")), F.lit(0.0)),
            "MIN": lambda: F.min(c),
            "MAX": lambda: F.max(c),
            "DISTINCT": lambda: F.array_join(F.sort_array(F.collect_set(text)), ","),
            "UNIQUE": lambda: F.array_join(F.sort_array(F.collect_set(text)), ","),
            "CONCAT": lambda: F.array_join(F.sort_array(F.collect_list(text)), ""),
            "JOIN": lambda: F.array_join(F.sort_array(F.collect_list(text)), ", "),
        }[f]()

    @staticmethod
    def title(call: Call) -> str:
        return f"{call.function}({call.argument.column if call.argument else '*'})"

    def tail(self, df: DataFrame, order, limit, offset, named=None) -> DataFrame:
        if order:
            keys = [(named(w) if named and isinstance(w, Call) else self.column(df, w), down) for w, down in order]
            df = df.orderBy(*[k.desc() if down else k.asc() for k, down in keys])
        if offset is not None:
            df = df.offset(int(self.value(offset)))
        return df if limit is None else df.limit(int(self.value(limit)))

    def project(self, df: DataFrame, items) -> DataFrame:
        if items is None or any(i.what == "*" for i in items):
            return df
        out = []
        for i in items:
            name = i.what.argument if isinstance(i.what, Call) else i.what
            out.append((F.col("distance") if isinstance(i.what, Call) and name is None else self.column(df, name)).alias(i.alias or (name.column if name else i.what.function.lower())))
        shown = df.select(*out)
        return shown.distinct() if any(isinstance(i.what, Call) and i.what.function == "ROWS_DISTINCT" for i in items) else shown

    # -- reads -----------------------------------------------------------------------------------------

    def source(self, label: str | None, as_of=None) -> DataFrame:
        if label is None:
            df = self.graph.all_nodes()
        elif label in self.views:
            df = self.views[label]
        elif label in self.materialized:
            df = self.view_rows(label)
        else:
            df = self.graph.scan(label)
        if not as_of:
            return df
        if not {"valid_from", "valid_to"} <= set(df.columns):
            raise Unsupported(f"{label} has no versions")
        return versions.system_time(df, as_of[0], *[self.value(v) for v in as_of[1:]])

    def _select(self, items, edges, as_of, where, group, having, order, limit, offset, **rest):
        indexed = None if edges or as_of else self.indexed(rest["from"], where)
        df = indexed if indexed is not None else self.graph.all_edges() if edges else self.source(rest["from"], as_of)
        df = df.filter(self.predicate(df, where))
        calls = [i for i in items if isinstance(i.what, Call) and i.what.function != "ROWS_DISTINCT"]
        if not calls and not group:
            if all(isinstance(i.what, Name) for i in items) and order:
                return self.project(self.tail(df, order, limit, offset), items)
            return self.tail(self.project(df, items), order, limit, offset)
        keys = [self.column(df, g).alias(g.column) for g in group]
        held: dict[Call, str] = {}
        aggregates = []
        wanted = [i.what for i in calls] + [w for w, _ in order if isinstance(w, Call)] + self._calls(having)
        for call in dict.fromkeys(wanted):
            held[call] = f"_a{len(held)}"
            aggregates.append(self.aggregate(df, call).alias(held[call]))
        shown = []
        for n, i in enumerate(items):
            if isinstance(i.what, Call):
                shown.append((held[i.what], i.alias or self.title(i.what)))
            elif i.what in group or i.what.column in {g.column for g in group}:
                shown.append((i.what.column, i.alias or i.what.column))
            else:  # a column that isn't grouped shows a value of the group: the smallest, so that it is one
                aggregates.append(F.min(self.column(df, i.what)).alias(f"_f{n}"))
                shown.append((f"_f{n}", i.alias or i.what.column))
        out = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
        named = lambda c: F.col(held[c])
        if having is not None:
            out = out.filter(self.predicate(out, having, named))
        alias = {a: h for h, a in shown}
        order = [(Name(alias[w.column]) if isinstance(w, Name) and w.column in alias else w, d) for w, d in order]
        out = self.tail(out, order, limit, offset, named)
        return out.select(*[F.col(h).alias(a) for h, a in shown])

    def _calls(self, test) -> list[Call]:
        if test is None:
            return []
        return [c for o in test.operands for c in ([o] if isinstance(o, Call) else self._calls(o) if isinstance(o, Test) else [])]

    def _prefixed(self, p: NodePattern, where: Test | None = None) -> DataFrame:
        df = self.source(p.label)
        for test in self._parts(where, p.alias):
            df = df.filter(self.predicate(df, test))
        for key, v in p.properties.items():
            df = df.filter(self.predicate(df, Test("=", (Name(key), v))))
        return df.select(*[F.col(c).alias(f"{p.alias}__{c}") for c in df.columns])

    def _match(self, nodes, edges, where, items, order, limit, offset):
        if not edges:
            indexed = self.indexed(nodes[0].label, where)
            df = self.source(nodes[0].label) if indexed is None else indexed
            if nodes[0].alias != nodes[0].label:
                df = df.select("*", *[F.col(c).alias(f"{nodes[0].alias}__{c}") for c in df.columns])
            df = df.filter(self.predicate(df, where))
            return self.project(self.tail(df, order, limit, offset), items)
        if not self._parts(where, nodes[0].alias) and not nodes[0].properties and (self._parts(where, nodes[-1].alias) or nodes[-1].properties) and any(e.most > 1 for e in edges):
            # paths grow from the side that is bounded
            turned = {"in": "out", "out": "in", "both": "both"}
            nodes, edges = nodes[::-1], [replace(e, direction=turned[e.direction]) for e in edges[::-1]]
        df = self._prefixed(nodes[0], where)
        for left, e, right in zip(nodes, edges, nodes[1:], strict=False):
            hop = self._hops(e, df.select(F.col(f"{left.alias}__id").alias("id")) if (e.least, e.most) != (1, 1) else None)
            if e.alias:
                hop = hop.withColumns({f"{e.alias}__type": F.col("_type"), f"{e.alias}__weight": F.col("_weight")})
            df = df.join(hop, df[f"{left.alias}__id"] == hop["_source"]).join(self._prefixed(right, where), F.col("_target") == F.col(f"{right.alias}__id"))
            df = df.drop("_source", "_target", "_type", "_weight")
        df = df.filter(self.predicate(df, where))
        calls = [i for i in items or [] if isinstance(i.what, Call) and i.what.argument is None and i.what.function in ("PATH_LENGTH", "HOP_COUNT")]
        if calls:
            df = df.withColumn("distance", F.lit(len(edges)))
        if items and any(isinstance(i.what, Call) and i.what.function in ("COUNT", "SUM", "AVG", "MIN", "MAX") for i in items):
            group = [i.what for i in items if isinstance(i.what, Name)]
            keys = [self.column(df, g).alias(f"_k{n}") for n, g in enumerate(group)]
            aggregates = [self.aggregate(df, i.what).alias(i.alias or self.title(i.what)) for i in items if isinstance(i.what, Call)]
            out = df.groupBy(*keys).agg(*aggregates)
            names = iter(range(len(group)))
            out = out.select(*[F.col(f"_k{next(names)}").alias(i.alias or i.what.column) if isinstance(i.what, Name) else F.col(f"`{i.alias or self.title(i.what)}`") for i in items])
            return self.tail(out, order, limit, offset)
        if order:
            return self.project(self.tail(df, order, limit, offset), items)
        return self.tail(self.project(df, items), order, limit, offset)

    def _hops(self, e, starts: DataFrame) -> DataFrame:
        """(_source, _target, _type, _weight) of an edge pattern; of paths between its least and most lengths, those from the
        starts."""
        one = traverse.directed(self.graph.all_edges(e.types), e.direction)
        if (e.least, e.most) == (1, 1):
            return one.select(*[F.col(c).alias(f"_{c}") for c in ("source", "target", "type", "weight")])
        some = paths.within(one, starts, e.least, e.most)
        return some.select(F.col("source").alias("_source"), F.col("target").alias("_target"), F.lit("|".join(e.types)).alias("_type"), F.lit(None).cast("double").alias("_weight"))

    def _parts(self, where: Test | None, alias: str) -> list[Test]:
        """The conditions that `where` puts on one alias alone."""
        tests = where.operands if where is not None and where.operator == "AND" else (where,)
        return [t for t in tests if isinstance(t, Test) and (names := self._owners(t)) and names == {alias}]

    def _owners(self, test: Test) -> set:
        """Whose columns a condition names; None among them for a bare column."""
        found = set()
        for o in test.operands:
            found |= self._owners(o) if isinstance(o, Test) else {o.owner} if isinstance(o, Name) else set()
        return found

    def _traverse(self, types, to, where, depth, least, direction, items, strategy, order, limit, offset, **rest):
        starts = self.source(rest["from"])
        starts = starts.filter(self.predicate(starts, where))
        if strategy:  # every way that uses no edge twice, in the order of the search
            found = paths.trails(self.graph.all_edges(types), starts.select("id"), int(self.value(least)), int(self.value(depth)), direction)
            found = found.join(self.source(to).select("id"), "id", "left_semi") if to else found
            found = found.select("start", "id", F.col("length").alias("distance"), F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"))
            ordered = found.orderBy("start", "path", "types") if strategy == "DFS" else found.orderBy("distance", "start", "path", "types")
            return self.project(self.tail(ordered, order, limit, offset), items)
        found = traverse.reachable(self.graph.all_edges(types), starts, int(self.value(depth)), direction, int(self.value(least)))
        named = self.source(to) if to else self.graph.all_nodes()
        out = named.join(found, "id")
        return self.project(self.tail(out, order, limit, offset), items)

    def _shortest_path(self, types, depth, to, **rest):
        return traverse.shortest_path(self.graph.all_edges(types), str(self.value(rest["from"])), str(self.value(to)), int(self.value(depth)))

    def _on(self, on: str | None) -> tuple[DataFrame, DataFrame]:
        """Edges and nodes: all, those of an edge type, or those of a node label and what it is linked to."""
        if on in self.graph.edges:
            e = self.graph.edges[on]
            edges = self.graph.all_edges([on])
            nodes = reduce(DataFrame.unionByName, [self.graph.scan(x).select("id") for x in dict.fromkeys((e.start, e.end))])
            return edges, nodes
        if on is None or on == "GRAPH":
            return self.graph.all_edges(), self.graph.all_nodes()
        nodes = self.graph.scan(on).select("id")
        return self.graph.induced(nodes), nodes

    def _pagerank(self, on, iterations, damping, order, limit, offset):
        edges, nodes = self._on(on)
        return self.tail(traverse.pagerank_undirected(edges, nodes, float(self.value(damping)), int(self.value(iterations))), order, limit, offset)

    def _communities(self, on, order, limit, offset):
        return self.tail(traverse.label_propagation(*self._on(on)), order, limit, offset)

    def _components(self, on, order, limit, offset):
        return self.tail(traverse.components(*self._on(on)), order, limit, offset)

    def _degree(self, on, order, limit, offset):
        kinds = [on] if on in self.graph.edges else None
        df = self.graph.degrees(kinds)
        if on and not kinds:
            df = df.join(self.graph.scan(on).select("id"), "id", "left_semi")
        return self.tail(df, order, limit, offset)

    def _summary(self, fields, **rest):
        df = self.source(rest["from"])
        if not fields:
            return df.groupBy().agg(F.count("*").alias("count"))
        return df.agg(*[self.aggregate(df, c).alias(k) for k, c in fields.items()])

    def _aggregate(self, call, where, group, **rest):
        df = self.source(rest["from"])
        df = df.filter(self.predicate(df, where))
        value = self.aggregate(df, call)
        value = F.round(value, 2) if call.function == "AVG" else value
        if group is None:
            return df.agg(value.alias("value"))
        key = F.coalesce(self.column(df, group).cast("string"), F.lit("unknown"))
        return df.groupBy(key.alias(group.column)).agg(value.alias("value"))

    def _point(self, id):
        return self.graph.by_id(str(self.value(id)))

    def _edges(self, where, order, limit, offset):
        df = self.graph.edges_with_names()
        return self.tail(df.filter(self.predicate(df, where)), order, limit, offset)

    def _nodes(self, where, order, limit, offset):
        return self.tail(self.graph.all_nodes(), order, limit, offset)

    def _induced(self, where, order, limit, offset):
        df = self.graph.all_nodes()
        return self.tail(self.graph.induced(df.filter(self.predicate(df, where))), order, limit, offset)

    def _show(self, what):
        rows = {
            "STATS": lambda: self.graph.all_nodes().groupBy("label").agg(F.count("*").alias("count")),
            "STATISTICS": lambda: self.graph.all_nodes().groupBy("label").agg(F.count("*").alias("count")),
            "NAMESPACES": lambda: self._names(list(self.spaces)),
            "GRAPHS": lambda: self._names(list(self.spaces)),
            "GRAPH": lambda: self._names([self.active]),
            "COLLECTIONS": lambda: self._names([*self.graph.nodes, *self.views, *self.materialized]),
            "INDEXES": self._indexes,
            "INDEX": self._indexes,
        }
        if what not in rows:
            raise Unsupported(f"unsupported statement: SHOW {what}")
        return rows[what]()

    def _names(self, names) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(names)], "name string")

    def _describe(self, what, of):
        df = self.graph.all_edges([of]) if what == "EDGE" else self.source(of)
        n = df.count()
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), n) for f in df.schema.fields], "property string, type string, count long")

    def _explain(self, of):
        df = self.execute(of)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _search(self, text, strategy, weights, where, order, limit, offset, **rest):
        label = rest["in"]
        df = self.source(None if label in (None, "NODES") else label)
        df = df.filter(self.predicate(df, where))
        column = next((c for c in ("text", "name") if c in df.columns), None)
        w = {k: float(self.value(v)) for k, v in weights.items()}
        index = self.catalogue.sparse(label, [column]) if self.catalogue is not None and strategy == "sparse" and where is None else None
        if index is not None:
            query = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(str(self.value(text))).alias("text"))
            got = index.bm25(query).select("id", "score")
            return self.tail(got, order or [(Name("score"), True), (Name("id"), False)], 10 if limit is None else limit, offset)
        got = search.ranked(df.select("id", F.col(column).cast("string").alias("text")), str(self.value(text)), strategy, w)
        return self.tail(got, order or [(Name("score"), True), (Name("id"), False)], 10 if limit is None else limit, offset)

    def _diff(self, label, id, to, **rest):
        df = self.source(label)
        return versions.diff(df if id is None else df.filter(F.col("id") == str(self.value(id))), self.value(rest["from"]), self.value(to))

    # -- writes: a graph is immutable, a statement replaces it ------------------------------------------

    def _create_node(self, label, properties):
        values = {k: self.value(v) for k, v in properties.items()}
        row = self.spark.range(1).select(
            F.lit(str(values["id"])).alias("id") if "id" in values else F.uuid().alias("id"),
            F.lit(values.get("name")).cast("string").alias("name"),
            *[F.lit(v).alias(k) for k, v in values.items() if k not in ("id", "name")],
        )
        row = traverse.cut(row)  # the id must not change when the row is read again
        old = self.graph.nodes.get(label)
        self.graph = self.graph.with_nodes(label, row if old is None else old.unionByName(row, allowMissingColumns=True))
        self.changed(label, "insert", None, row)
        return row

    def _create_edge(self, type, source, target, where, properties):
        w = float(self.value(properties.get("weight", 1.0)))
        row = self.spark.createDataFrame([(str(self.value(source)), str(self.value(target)), w)], "source string, target string, weight double")
        old = self.graph.edges.get(type)
        self.graph = self.graph.with_edges(type, Edges(row if old is None else old.df.unionByName(row, allowMissingColumns=True), old.start if old else "", old.end if old else ""))
        self.changed(type, "edge", None, None)
        return row

    def _update(self, what, label, set, where):
        values = {k: F.lit(self.value(v)) for k, v in set.items()}
        if what == "EDGE":
            e = self.graph.edges[label]
            hit = F.coalesce(self.predicate(e.df, where), F.lit(False))
            self.graph = self.graph.with_edges(label, Edges(versions.updated(e.df, hit, values), e.start, e.end))
            self.changed(label, "edge", None, None)
            return e.df.filter(hit)
        for one in [label] if label else list(self.graph.nodes):
            df = self.graph.scan(one)
            hit = F.coalesce(self.predicate(df, where), F.lit(False))
            self.graph = self.graph.with_nodes(one, versions.updated(df, hit, values))
            if self.watched(one):
                old = df.filter(hit)
                self.changed(one, "update", old, versions.updated(old, F.lit(True), {k: F.lit(self.value(v)) for k, v in set.items()}))
        return self.source(label)

    def _delete(self, what, label, where):
        if what == "EDGE":
            e = self.graph.edges[label]
            self.graph = self.graph.with_edges(label, Edges(e.df.filter(~F.coalesce(self.predicate(e.df, where), F.lit(False))), e.start, e.end))
            self.changed(label, "edge", None, None)
            return None
        gone = []
        for one in [label] if label else list(self.graph.nodes):
            df = self.graph.scan(one)
            hit = F.coalesce(self.predicate(df, where), F.lit(False))
            gone.append(df.filter(hit).select("id"))
            self.graph = self.graph.with_nodes(one, df.filter(~hit))
            if self.watched(one):
                self.changed(one, "delete", df.filter(hit), None)
        ids = reduce(DataFrame.unionByName, gone)
        self.graph = versions.without_nodes(self.graph, ids)
        return ids

    def _merge_node(self, label, keys, set):
        df = self.graph.scan(label)
        test = Test("AND", tuple(Test("=", (Name(k), v)) for k, v in keys.items()))
        if df.filter(self.predicate(df, test)).isEmpty():
            return self._create_node(label, {**keys, **set})
        return self._update("NODE", label, set, test) if set else df.filter(self.predicate(df, test))

    def _merge_results(self, names):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.views[n] for n in names])

    def _create_view(self, name, of):
        self.views[name] = self.execute(of)
        return self.views[name]

    def _create_space(self, what, name):
        if what == "COLLECTION":
            return self._names([*self.graph.nodes, name])
        self.spaces.setdefault(name, PropertyGraph())

    def _use(self, name):
        if name not in self.spaces:
            raise Unsupported(f"no namespace {name}")
        self.active = name

    def _drop(self, what, name):
        if what in ("GRAPH", "NAMESPACE"):
            self.spaces.pop(name, None)
        elif what == "INDEX" and self.catalogue is not None:
            self.catalogue.drop(name)
        elif what == "MATERIALIZED":
            self.materialized.pop(name, None)
        else:
            self.views.pop(name, None)

    def _let(self, name, value):
        self.variables[name] = self.value(value)

    def _each(self, name, over, body):
        out = None
        for v in self.value(over):
            self.variables[name] = self.value(v)
            for s in body:
                out = self.execute(s)
        return out

    def _function(self, name, parameters, body):
        """A SQL function, inlined by the optimizer."""
        named = ", ".join(f"{p} STRING" for p in parameters)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({named}) RETURNS STRING RETURN {body}")

    def _load(self, format, path, into, options):
        from weftgraph.sources import readers

        df = readers.load(self.spark, format, str(self.value(path)), {k: self.value(v) for k, v in options.items()})
        if into:
            self.views[into] = df
        return df
