"""Materialised views kept up by changes: grouped aggregates whose partial results add up, deletions included.

A view keeps partial results, not rows: for each group its number of rows, and for each column the number and sum of its
values; where MIN, MAX or COUNT DISTINCT is asked for, how often each value occurs. A change is a row with a sign, +1 for what
came and -1 for what went (an update is both). A refresh sums the changes by group and adds the result as a new segment, so it
reads and shuffles only changes; reading the view sums the segments. When there are many of them they are merged into one.

    folder/view.json             segments, the last change batch taken in, and what waits to be taken in
    folder/<segment>/sums        groups with partial sums; values_<column> beside it
    folder/waiting/<n>           changes that no refresh has taken in

Sums are of doubles; a group goes when it has no rows left. A batch that is applied again is left out by its number. Groups of
null are groups. Counts, sums and averages of nothing are 0, minimum and maximum null.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.logs import Folder

SIGN = "_sign"
#: Segments at which a refresh merges them.
MERGE_AT = 16
BY_SUMS, BY_VALUES = ("COUNT", "SUM", "AVG"), ("MIN", "MAX", "COUNT DISTINCT")


@dataclass(frozen=True)
class Aggregate:
    """name: the column of the view; column None: rows."""

    name: str
    function: str
    column: str | None = None

    def __post_init__(self):
        if self.function not in (*BY_SUMS, *BY_VALUES):
            raise ValueError(f"{self.function} can't be kept up from changes")


def signed(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Change rows: what went and what came."""
    parts = [df.withColumn(SIGN, F.lit(sign)) for df, sign in ((old, -1), (new, 1)) if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def of_log(log: DataFrame, op: str = "op", old: str = "old", new: str = "new") -> DataFrame:
    """Change rows of a log with an operation (INSERT, UPDATE, DELETE) and the row before and after as structs."""
    both = F.array(F.struct(F.lit(-1).alias(SIGN), F.when(F.col(op) != "INSERT", F.col(old)).alias("r")), F.struct(F.lit(1).alias(SIGN), F.when(F.col(op) != "DELETE", F.col(new)).alias("r")))
    rows = log.select(F.explode(both).alias("c")).select(f"c.{SIGN}", "c.r").filter(F.col("r").isNotNull())
    return rows.select("r.*", SIGN)


class MaterializedView:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], aggregates: list[Aggregate]):
        self.spark, self.url, self.folder, self.keys, self.aggregates = spark, folder.rstrip("/"), Folder(folder), keys, aggregates
        self.summed = sorted({a.column for a in aggregates if a.column and a.function in BY_SUMS})
        self.counted = sorted({a.column for a in aggregates if a.column and a.function in BY_VALUES})

    @classmethod
    def create(cls, source: DataFrame, folder: str, keys: list[str], aggregates: list[Aggregate]) -> MaterializedView:
        """A new view of all rows of a source."""
        view = cls(source.sparkSession, folder, keys, aggregates)
        view.folder.put("view.json", {"keys": keys, "aggregates": [asdict(a) for a in aggregates], "segments": [], "applied": -1, "waiting": []}, replace=False)
        view._add(signed(None, source), {})
        return view

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> MaterializedView:
        """The view that another session left."""
        known = Folder(folder).get("view.json")
        return cls(spark, folder, known["keys"], [Aggregate(**a) for a in known["aggregates"]])

    def _state(self) -> dict:
        return self.folder.get("view.json")

    # -- partial results ------------------------------------------------------------------------------

    def _sums(self, changes: DataFrame) -> DataFrame:
        def number(c):
            return F.col(c).try_cast("double")

        parts = [F.sum(SIGN).cast("long").alias("_n")]
        for c in self.summed:
            parts += [F.sum(F.when(F.col(c).isNotNull(), F.col(SIGN)).otherwise(0)).cast("long").alias(f"_k_{c}"), F.sum(number(c) * F.col(SIGN)).alias(f"_s_{c}"), F.sum(F.when(number(c).isNotNull(), F.col(SIGN)).otherwise(0)).cast("long").alias(f"_m_{c}")]
        return changes.groupBy(*self.keys).agg(*parts)

    def _values(self, changes: DataFrame, column: str) -> DataFrame:
        return changes.filter(F.col(column).isNotNull()).groupBy(*self.keys, F.col(column).alias("_value")).agg(F.sum(SIGN).cast("long").alias("_n"))

    def _write(self, segment: str, sums: DataFrame, values: dict[str, DataFrame]) -> None:
        sums.write.mode("overwrite").parquet(f"{self.url}/{segment}/sums")
        for column, df in values.items():
            df.write.mode("overwrite").parquet(f"{self.url}/{segment}/values_{column}")

    def _add(self, changes: DataFrame, more: dict) -> None:
        segment = uuid.uuid4().hex
        self._write(segment, self._sums(changes), {c: self._values(changes, c) for c in self.counted})
        state = self._state()
        self.folder.put("view.json", state | {"segments": [*state["segments"], segment]} | more)
        if len(state["segments"]) + 1 >= MERGE_AT:
            self.merge()

    def _merged(self, table: str, keys: list[str]) -> DataFrame:
        """The segments of one table added up; groups and values that are no more are gone."""
        df = self.spark.read.parquet(*[f"{self.url}/{s}/{table}" for s in self._state()["segments"]])
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in keys]).filter(F.col("_n") > 0)

    def merge(self) -> None:
        """All segments into one; old ones stay where they are for readers that still use them."""
        segment = uuid.uuid4().hex
        self._write(segment, self._merged("sums", self.keys), {c: self._merged(f"values_{c}", [*self.keys, "_value"]) for c in self.counted})
        self.folder.put("view.json", self._state() | {"segments": [segment]})

    # -- changes ----------------------------------------------------------------------------------------

    def apply(self, changes: DataFrame, batch: int | None = None) -> bool:
        """Takes changes in; False if this batch was taken in before."""
        state = self._state()
        if batch is not None and batch <= state["applied"]:
            return False
        self._add(changes, {} if batch is None else {"applied": batch})
        return True

    def later(self, changes: DataFrame) -> None:
        """Keeps changes until the next refresh."""
        name = uuid.uuid4().hex
        changes.write.parquet(f"{self.url}/waiting/{name}")
        state = self._state()
        self.folder.put("view.json", state | {"waiting": [*state["waiting"], name]})

    def refresh(self) -> int:
        """Takes in what waits; how many lots of changes that were."""
        waiting = self._state()["waiting"]
        if waiting:
            lots = [self.spark.read.parquet(f"{self.url}/waiting/{name}") for name in waiting]
            self._add(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lots), {"waiting": []})
        return len(waiting)

    # -- reading ------------------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """The keys and aggregates of the groups that have rows."""
        out = self._merged("sums", self.keys)
        for column in self.counted:
            values = self._merged(f"values_{column}", [*self.keys, "_value"])
            one = values.groupBy(*[F.col(k).alias(f"_x_{k}") for k in self.keys]).agg(F.min("_value").alias(f"_lo_{column}"), F.max("_value").alias(f"_hi_{column}"), F.count("*").alias(f"_d_{column}"))
            same = reduce(lambda a, b: a & b, [out[k].eqNullSafe(one[f"_x_{k}"]) for k in self.keys], F.lit(True))
            out = out.join(one, same, "left").drop(*[f"_x_{k}" for k in self.keys])

        def shown(a: Aggregate):
            c = a.column
            return {
                "COUNT": lambda: F.col("_n") if c is None else F.col(f"_k_{c}"),
                "SUM": lambda: F.when(F.col(f"_m_{c}") > 0, F.col(f"_s_{c}")).otherwise(0.0),
                "AVG": lambda: F.when(F.col(f"_m_{c}") > 0, F.col(f"_s_{c}") / F.col(f"_m_{c}")).otherwise(0.0),
                "MIN": lambda: F.col(f"_lo_{c}"),
                "MAX": lambda: F.col(f"_hi_{c}"),
                "COUNT DISTINCT": lambda: F.coalesce(F.col(f"_d_{c}"), F.lit(0)),
            }[a.function]()

        return out.select(*self.keys, *[shown(a).alias(a.name) for a in self.aggregates])
