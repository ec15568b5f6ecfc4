"""Memory and shuffles of single steps, told by what they give out."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators import chunking, paths, search, textops


class Frame:
    """Stands in for a DataFrame and gives the function that its workers would run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def mapInArrow(self, run, schema):
        return run


def test_chunks_leave_in_parts_of_bounded_text():
    texts = ["A sentence of some words. " * 10_000, None, "", *["Short one. Another one."] * 40, *["Long lines here. " * 20_000] * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for strategy in ("hierarchical", "token_based", "dialogue_aware", "adaptive"):
        parts = list(textops.chunk_python(Frame(), strategy, size=600, overlap=60)([batch]))
        longest = max(len(t or "") for t in texts)
        assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= textops.CHUNKED + longest for p in parts) and len(parts) > 1
        rows = [r for p in parts for r in p.to_pylist()]
        assert [r["doc_id"] for r in rows] == list(range(len(texts)))
        for r in rows[:45]:
            assert [(c["text"], c["start"], c["end"]) for c in r["chunks"]] == list(chunking.STRATEGIES[strategy](r["text"] or "", 600, 60))


def test_a_scan_is_dealt_over_more_partitions_for_more_documents(spark, monkeypatch):
    monkeypatch.setattr(search, "DEALT", 2)
    docs = spark.createDataFrame([(i, f"the sea and the shore {'of stones' if i % 3 else 'of sand'} number{i}") for i in range(60)], "id long, text string")
    queries = spark.createDataFrame([(1, "sea shore stones"), (2, "sand of the sea")], "query_id long, text string")
    scored = search.bm25_scan(queries, docs, ["text"])
    assert re.search(r"RepartitionByExpression \[id#\d+L?\], 30\b", scored._jdf.queryExecution().optimizedPlan().toString())
    kept = search.bm25(queries, search.postings(docs, ["text"]), docs)
    rows = lambda df: sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())
    assert rows(scored) == rows(kept)


def test_what_if_walks_both_worlds_at_once(spark, monkeypatch):
    rows = [("a", "b", "T", 0.9, 0.0), ("b", "c", "T", 0.9, 0.1), ("c", "d", "T", 0.8, 0.0), ("a", "e", "U", 0.5, 0.0), ("e", "d", "T", 0.9, 0.0), ("x", "b", "T", 0.7, 0.0), ("x", "e", "U", 0.3, 0.0)]
    edges = spark.createDataFrame(rows, "source string, target string, type string, weight double, decay double")
    changes = [("b", "c", "T", 0.0, 0.0, True), ("a", "e", "U", 0.8, 0.1, False), ("x", "d", "V", 0.6, 0.0, None), ("no", "where", "T", 0.1, 0.0, True)]
    changed = spark.createDataFrame(changes, "source string, target string, type string, weight double, decay double, removed boolean")
    sources = spark.createDataFrame([("a", -1.0), ("x", 0.9), ("lone", 1.0)], "id string, value double")
    before = paths.impact(edges, sources).select("start", "id", F.col("strength").alias("before"))
    after = paths.impact(paths.overlaid(edges, changed), sources).select("start", "id", F.col("strength").alias("after"))
    want = {tuple(r) for r in before.join(after, ["start", "id"], "full_outer").fillna(0.0).filter("before <> after").collect()}
    walks, walk = [], paths.first_visits
    monkeypatch.setattr(paths, "first_visits", lambda *a, **k: walks.append(a) or walk(*a, **k))
    got = {(r["start"], r["id"], r["before"], r["after"]) for r in paths.what_if(edges, changed, sources).collect()}
    assert got == want and ("a", "c", 0.729, 0.0) in got and ("x", "d", 0.243, 0.54) in got
    assert len(walks) == 1
