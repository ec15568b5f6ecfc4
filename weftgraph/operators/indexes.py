"""Indexes as written tables, found again by a catalogue, used by searches and filters, and kept up by deltas.

    folder/catalogue.json        name -> kind, label, columns, folder of the index
    <index>/index.json           segments, documents and terms in all, fields
    <index>/<segment>/postings   (term, id, tf, terms), as they were counted where documents were read: runs in the order of stems, so a
                                 search reads the pages of its terms; under the empty term each document with its number of terms,
                                 which is null for ids that were deleted
    <index>/rows                 a property or time index: the rows sorted by its columns over all files

SPARSE indexes take new, changed and deleted documents as further segments; of an id only its last segment counts. merge()
makes one segment of all. TEMPORAL and COMPOSITE indexes are sorted copies; filters on the first column read what their file
and row group bounds let through. Their table's change makes them stale, and they aren't used until they are built again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import search
from weftgraph.sources.logs import Folder

KINDS = ("SPARSE", "TEMPORAL", "COMPOSITE")
#: Terms up to which a search filters the postings by value; beyond, it joins them.
LISTED = 1000
#: Postings of a run of a merged segment; replaced ids up to which they are broadcast.
RUN, REPLACED = 1_000_000, 2_000_000


class SparseIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.url, self.folder = spark, folder.rstrip("/"), Folder(folder)

    @classmethod
    def create(cls, docs: DataFrame, folder: str, fields: list[str]) -> SparseIndex:
        """docs: one row an id (column id) and the fields."""
        index = cls(docs.sparkSession, folder)
        segment, n_docs, n_terms = index._write(docs, fields)
        index.folder.put("index.json", {"fields": fields, "segments": [segment], "n_docs": n_docs, "n_terms": n_terms}, replace=False)
        return index

    def state(self) -> dict:
        known = self.folder.get("index.json")
        if known is None:
            raise FileNotFoundError(f"no index in {self.url}")
        return known

    def _table(self, segment: str, name: str) -> DataFrame:
        """The postings of a segment, its ids (id, terms), or both (all), where ids have the empty term."""
        every = self.spark.read.parquet(f"{self.url}/{segment}/postings")
        # not a filter that is pushed down: those are the search's own terms
        return {"postings": every.filter("coalesce(term, '') <> ''"), "ids": every.filter("term = ''").select("id", "terms"), "all": every}[name]

    def _write(self, docs: DataFrame, fields: list[str], gone: DataFrame | None = None) -> tuple[str, int, int]:
        """Documents are cut into stems once, and what is counted is written by the task that read them."""
        segment = uuid.uuid4().hex
        post = search.unpacked(search.packed(search.stemmed(docs, fields), fields, lengths=True)).select("term", "id", "tf", "terms")
        self._store(segment, post if gone is None else post.unionByName(gone.select(F.lit("").alias("term"), "id", F.lit(None).cast("double").alias("tf"), F.lit(None).cast("int").alias("terms"))))
        sums = self._table(segment, "ids").filter("terms IS NOT NULL").agg(F.count("*").alias("d"), F.coalesce(F.sum("terms"), F.lit(0)).alias("t")).first()
        return segment, sums["d"], sums["t"]

    def _store(self, segment: str, post: DataFrame) -> None:
        post.write.option("compression", "zstd").parquet(f"{self.url}/{segment}/postings")

    # -- deltas ---------------------------------------------------------------------------------------------

    def update(self, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """New or changed documents, and ids that are no more."""
        state = self.state()
        if new is None:
            new = self.spark.createDataFrame([], self._table(state["segments"][0], "ids").select("id").schema).select("id", *[F.lit(None).cast("string").alias(f) for f in state["fields"]])
        gone = None if gone is None else gone.select("id").join(new.select("id"), "id", "left_anti").distinct()
        segment, n_docs, n_terms = self._write(new, state["fields"], gone)
        replaced = self.ids().join(self._table(segment, "ids").select("id"), "id", "left_semi").agg(F.count("*").alias("d"), F.coalesce(F.sum("terms"), F.lit(0)).alias("t")).first()
        self.folder.put("index.json", state | {"segments": [*state["segments"], segment], "n_docs": state["n_docs"] - replaced["d"] + n_docs, "n_terms": state["n_terms"] - replaced["t"] + n_terms})

    def _last(self, name: str) -> DataFrame:
        """The rows of all segments whose id comes in no later segment."""
        segments, parts = self.state()["segments"], []
        later = None
        for segment in reversed(segments):
            rows, ids = self._table(segment, name), self._table(segment, "ids").select("id")
            parts.append(rows if later is None else rows.join(search.small(ids.join(later, "id", "left_semi"), REPLACED), "id", "left_anti"))
            later = ids if later is None else later.unionByName(ids)
        return reduce(DataFrame.unionByName, parts)

    def ids(self) -> DataFrame:
        """(id, terms) of the documents that there are."""
        return self._last("ids").filter(F.col("terms").isNotNull())

    def postings(self) -> DataFrame:
        """(term, id, tf, terms) of the documents that there are."""
        return self._last("postings")

    def merge(self) -> None:
        """All segments into one; old ones stay for readers that still use them."""
        segment, state = uuid.uuid4().hex, self.state()
        self._store(segment, search.in_runs(self._last("all").filter("term <> '' OR terms IS NOT NULL"), RUN))
        self.folder.put("index.json", state | {"segments": [segment]})

    # -- use --------------------------------------------------------------------------------------------------

    def document_frequencies(self) -> DataFrame:
        """(term, df)."""
        return self.postings().groupBy("term").agg(F.count("*").alias("df"))

    def bm25(self, queries: DataFrame, k1: float = search.K1, b: float = search.B) -> DataFrame:
        """(query_id, id, score) of all documents that share a term with a query: reads the postings of the queries' terms."""
        state = self.state()
        terms = search.cut(search.query_terms(queries))
        distinct = terms.select("term").distinct()
        some = [r.term for r in distinct.limit(LISTED + 1).collect()]  # at most LISTED + 1 rows
        asked = (lambda df: df.filter(F.col("term").isin(some))) if len(some) <= LISTED else (lambda df: df.join(search.small(distinct), "term", "left_semi"))
        post = asked(self.postings())
        frequencies = post.groupBy("term").agg(F.count("*").alias("df"))
        mean = max(state["n_terms"] / max(state["n_docs"], 1), 1.0)
        weights = terms.join(frequencies, "term").select("query_id", "term", search.idf(F.lit(state["n_docs"]), F.col("df")).alias("idf"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("terms") / mean))
        return post.join(search.small(search.cut(weights)), "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


class SortedIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.url = spark, folder.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, folder: str, columns: list[str]) -> SortedIndex:
        df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.parquet(f"{folder.rstrip('/')}/rows")
        return cls(df.sparkSession, folder)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.url}/rows")


class IndexCatalogue:
    """The indexes of a folder by name; another session that opens the folder finds them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.url, self.folder = spark, folder.rstrip("/"), Folder(folder)

    def all(self) -> dict[str, dict]:
        return self.folder.get("catalogue.json") or {}

    def create(self, name: str, label: str, columns: list[str], kind: str, df: DataFrame) -> dict:
        if kind not in KINDS:
            raise ValueError(f"indexes of type {kind} aren't offered")
        entry = {"kind": kind, "label": label, "columns": columns, "folder": f"{self.url}/{name}-{uuid.uuid4().hex}", "stale": False}
        if kind == "SPARSE":
            SparseIndex.create(df.select("id", *columns), entry["folder"], columns)
        else:
            SortedIndex.create(df, entry["folder"], columns)
        self.folder.put("catalogue.json", self.all() | {name: entry})
        return entry

    def drop(self, name: str) -> None:
        self.folder.put("catalogue.json", {k: v for k, v in self.all().items() if k != name})

    def sparse(self, label: str, columns: list[str]) -> SparseIndex | None:
        for entry in self.all().values():
            if entry["kind"] == "SPARSE" and entry["label"] == label and entry["columns"] == columns and not entry["stale"]:
                return SparseIndex(self.spark, entry["folder"])
        return None

    def sorted_by(self, label: str, columns: set[str]) -> DataFrame | None:
        """The rows of a label sorted by one of the columns first, if there is such an index."""
        for entry in self.all().values():
            if entry["kind"] != "SPARSE" and entry["label"] == label and entry["columns"][0] in columns and not entry["stale"]:
                return SortedIndex(self.spark, entry["folder"]).read()
        return None

    def changed(self, label: str, old: DataFrame | None, new: DataFrame | None) -> None:
        """A label's rows went or came: sparse indexes take that in, sorted ones are stale from now on."""
        entries = self.all()
        for entry in entries.values():
            if entry["label"] != label or entry["stale"]:
                continue
            if entry["kind"] == "SPARSE":
                some = None if new is None else new.select("id", *entry["columns"])
                SparseIndex(self.spark, entry["folder"]).update(some, old)
            else:
                entry["stale"] = True
        self.folder.put("catalogue.json", entries)
