"""States of a graph saved, restored and deleted."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import textops as T
from weftgraph.operators.checkpoints import Checkpoints
from weftgraph.operators.graph import Edges, PropertyGraph


def test_checkpoints(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, name string, k int")
    links = spark.createDataFrame([("1", "2", 1.0)], "source string, target string, weight double")
    first = PropertyGraph().with_nodes("P", nodes).with_edges("E", Edges(links, "P", "P"))
    c = Checkpoints(spark, f"{tmp_path}/c")
    c.save(first, "one", "begin")
    second = first.with_nodes("P", nodes.withColumn("k", F.col("k") + 1)).with_nodes("Q", nodes.limit(1))
    entry = c.save(second, "two")
    assert entry["tables"]["edge:E"]["path"].endswith("/0/edge=E") and entry["tables"]["node:P"]["path"].endswith("/1/node=P")  # only what differs is written
    assert sorted(map(tuple, c.changed("one", "two").collect())) == [("node:P", "modified"), ("node:Q", "added")]
    back = Checkpoints(spark, f"{tmp_path}/c").restore("one")
    assert sorted(r.k for r in back.scan("P").collect()) == [1, 2] and set(back.nodes) == {"P"} and back.edges["E"].start == "P"
    c.save(back, "three")
    assert [(r.name, r.parent, r.tables, r.rows) for r in c.list().collect()] == [("one", None, 2, 3), ("two", "one", 3, 4), ("three", "one", 2, 3)]
    c.delete("one")
    assert [(r.name, r.parent) for r in c.list().collect()] == [("two", None), ("three", None)]
    assert c.restore("two").scan("P").count() == 2  # also what the deleted one wrote
    with pytest.raises(FileNotFoundError):
        c.restore("one")
    with pytest.raises(FileExistsError):
        c.save(back, "two")


def test_summaries(spark):
    def plain(text, n):
        if len(text) <= n:
            return text
        cut = text[:n]
        space = cut.rfind(" ")
        return (cut[:space] if space > n // 2 else cut) + "..."

    texts = ["", "short", "one two three four five", "averyverylongwordindeed", "ab averyverylongwordindeed", "é é é é é é é é", "exactly ten", "a          b  c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (5, 10, 11):
        assert [r[0] for r in df.select(T.summary(F.col("t"), n)).collect()] == [plain(t, n) for t in texts]
    rows = df.limit(1).select(*[T.at_tier(F.lit("some words that go on"), F.lit(k), F.lit("Fact"), F.lit(0.5), 10) for k in range(4)]).first()
    assert list(rows) == ["some words that go on", "some words...", "[Fact] ~5 tokens, confidence: 0.50", ""]
