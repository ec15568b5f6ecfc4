"""Registry of runnable queries: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """A query, the SQL that has to give the same rows, and the operator ids it covers."""

    run: Query
    sql: str | None = None
    covers: str = ""


class Catalog(dict[str, Entry]):
    """Names are unique; registering one twice is a programming error."""

    def add(self, name: str, sql: str | None = None, covers: str = ""):
        def keep(run: Query) -> Query:
            if name in self:
                raise KeyError(f"query {name} is registered twice")
            self[name] = Entry(run, sql, covers)
            return run

        return keep
