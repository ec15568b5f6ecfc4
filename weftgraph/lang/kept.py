"""Statements over what is kept beside a graph: materialised views and indexes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lang.parser import Call, Name, Statement, Test, Unsupported
from weftgraph.operators.indexes import IndexCatalogue
from weftgraph.operators.lineage import fresh_folder
from weftgraph.operators.matviews import BY_SUMS, BY_VALUES, Aggregate, MaterializedView, signed

EVENTS = {"chunk_insert": {"insert"}, "chunk_update": {"update"}, "chunk_delete": {"delete"}, "node_change": {"insert", "update", "delete"}, "edge_change": {"edge"}}


@dataclass
class Materialized:
    """A view with what it is made of. view is None where changes can't keep it up; then a refresh runs it again."""

    of: Statement
    label: str | None
    view: MaterializedView | None
    table: str | None
    names: list[tuple[str, str]]
    event: str | None = None
    every: timedelta | None = None
    refreshed: datetime | None = None
    behind: bool = False


class Kept:
    """Part of a session. `catalogue` may be an IndexCatalogue that another session filled."""

    catalogue: IndexCatalogue | None = None

    # -- materialised views -------------------------------------------------------------------------------

    def _create_materialized(self, name, of, event, every):
        if event is not None and event not in EVENTS:
            raise Unsupported(f"no event {event}")
        label, shown = of.args.get("from"), self._aggregates(of)
        held = Materialized(of, label, None, None, [], event, every and timedelta(seconds=every))
        if shown:
            keys, aggregates, held.names = shown
            df = self.source(label)
            rows = df.filter(self.predicate(df, of.args["where"]))
            held.view = MaterializedView.create(rows, fresh_folder(self.spark, "view"), keys, aggregates)
        self.materialized[name] = held
        self._rerun(held)
        return self.source(name)

    def _aggregates(self, of: Statement):
        """(keys, aggregates, (column of the view, column shown)) of a grouped select that changes can keep up; else None."""
        a = of.args
        if of.kind != "select" or a["edges"] or a["as_of"] or not a["group"] or a["having"] is not None or a["order"] or a["limit"] is not None or a["offset"] is not None or a["from"] not in self.graph.nodes:
            return None
        keys, aggregates, names = [g.column for g in a["group"]], [], []
        for n, i in enumerate(a["items"]):
            if isinstance(i.what, Call):
                function = i.what.function + (" DISTINCT" if i.what.modifier == "DISTINCT" else "")
                if function not in (*BY_SUMS, *BY_VALUES):
                    return None
                aggregates.append(Aggregate(f"_a{n}", function, i.what.argument.column if isinstance(i.what.argument, Name) else None))
                names.append((f"_a{n}", i.alias or self.title(i.what)))
            elif isinstance(i.what, Name) and i.what.column in keys:
                names.append((i.what.column, i.alias or i.what.column))
            else:
                return None
        return keys, aggregates, names

    def _rerun(self, held: Materialized) -> None:
        if held.view is None:
            held.table = fresh_folder(self.spark, "view")
            self.execute(held.of).write.parquet(held.table)
        held.behind = False

    def view_rows(self, name: str) -> DataFrame:
        """A materialised view as it was last refreshed."""
        held = self.materialized[name]
        if held.view is None:
            return self.spark.read.parquet(held.table)
        rows = held.view.read()
        return rows.select(*[F.col(c).alias(shown) for c, shown in held.names])

    def _refresh(self, name):
        held = self.materialized.get(name)
        if held is None:
            raise Unsupported(f"no materialized view {name}")
        if held.view is not None:
            held.view.refresh()
            held.behind = False
        elif held.behind:
            self._rerun(held)
        return self.view_rows(name)

    def tick(self, now: datetime) -> list[str]:
        """Refreshes the views whose interval has passed; their names. The first tick starts the intervals."""
        done = []
        for name, held in self.materialized.items():
            if held.every is None:
                continue
            if held.refreshed is None:
                held.refreshed = now
            elif now - held.refreshed >= held.every:
                self._refresh(name)
                held.refreshed = now
                done.append(name)
        return done

    def watched(self, label: str) -> bool:
        """Whether a view or an index has to know of a label's changes."""
        known = self.catalogue.all().values() if self.catalogue is not None else ()
        return any(h.label == label for h in self.materialized.values()) or any(e["label"] == label for e in known)

    def changed(self, label: str, kind: str, old: DataFrame | None, new: DataFrame | None) -> None:
        """Tells views and indexes that rows of a label (or edges of a type) went and came."""
        if self.catalogue is not None:
            self.catalogue.changed(label, old, new)
        for name, held in self.materialized.items():
            if held.view is not None and held.label != label:
                continue
            held.behind = True
            if held.view is not None:
                rows = signed(old, new)
                held.view.later(rows.filter(self.predicate(rows, held.of.args["where"])))
            if held.event and kind in EVENTS[held.event]:
                self._refresh(name)

    # -- indexes ----------------------------------------------------------------------------------------------

    def _create_index(self, name, label, columns, type):
        if self.catalogue is None:
            self.catalogue = IndexCatalogue(self.spark, fresh_folder(self.spark, "indexes"))
        df = self.source(label)
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise Unsupported(f"{label} has no column {missing[0]}")
        try:
            self.catalogue.create(name, label, columns, type, df)
        except ValueError as e:
            raise Unsupported(str(e)) from e
        return self._indexes()

    def _indexes(self) -> DataFrame:
        rows = [(n, e["kind"], e["label"], ",".join(e["columns"])) for n, e in sorted((self.catalogue.all() if self.catalogue else {}).items())]
        return self.spark.createDataFrame(rows, "name string, type string, label string, columns string")

    def indexed(self, label: str | None, where: Test | None) -> DataFrame | None:
        """The rows of a label out of an index that is sorted by a column that `where` bounds."""
        if self.catalogue is None or label is None or label in self.views or label in self.materialized:
            return None
        tests = where.operands if where is not None and where.operator == "AND" else (where,)
        bounds = ("=", "<", "<=", ">", ">=", "IN", "BETWEEN")
        columns = {t.operands[0].column for t in tests if isinstance(t, Test) and t.operator in bounds and isinstance(t.operands[0], Name)}
        return self.catalogue.sorted_by(label, columns)
