"""Materialised views and indexes against what is computed from scratch."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftgraph.lang import Session
from weftgraph.lang.parser import Unsupported
from weftgraph.operators import matviews as V
from weftgraph.operators import search
from weftgraph.operators.graph import PropertyGraph, graph_of_tables
from weftgraph.operators.indexes import IndexCatalogue, SparseIndex

SF = "/root/testdata/sf0.001"
KIND = "id int, g string, h int, x double, t string"
AGGREGATES = [V.Aggregate("n", "COUNT"), V.Aggregate("k", "COUNT", "x"), V.Aggregate("s", "SUM", "x"), V.Aggregate("a", "AVG", "x"), V.Aggregate("lo", "MIN", "t"), V.Aggregate("hi", "MAX", "t"), V.Aggregate("d", "COUNT DISTINCT", "t")]


def from_scratch(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], r[2]].append(r)
    out = []
    for (g, h), some in groups.items():
        x, t = [r[3] for r in some if r[3] is not None], [r[4] for r in some if r[4] is not None]
        out.append((g, h, len(some), len(x), round(sum(x), 6), round(sum(x) / len(x), 6) if x else 0.0, min(t, default=None), max(t, default=None), len(set(t))))
    return sorted(out, key=str)


def shown(view):
    return sorted(((r.g, r.h, r.n, r.k, round(r.s, 6), round(r.a, 6), r.lo, r.hi, r.d) for r in view.read().collect()), key=str)


def test_view_after_changes(spark, tmp_path):
    rng = random.Random(1)

    def row(i):
        return (i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 1.5, -2.0, 7.25]), rng.choice([None, "p", "q", "r", "s"]))

    held = {i: row(i) for i in range(60)}
    view = V.MaterializedView.create(spark.createDataFrame(list(held.values()), KIND), f"{tmp_path}/v", ["g", "h"], AGGREGATES)
    assert shown(view) == from_scratch(held.values())
    for batch in range(3):
        log = []
        for i in rng.sample(sorted(held), 25):
            if rng.random() < 0.5:
                log.append(("DELETE", held.pop(i), None))
            else:
                new = row(i)
                log.append(("UPDATE", held[i], new))
                held[i] = new
        for i in range(100 * batch + 100, 100 * batch + 110):
            held[i] = row(i)
            log.append(("INSERT", None, held[i]))
        changes = V.of_log(spark.createDataFrame(log, f"op string, old struct<{KIND.replace(' ', ':')}>, new struct<{KIND.replace(' ', ':')}>".replace(",:", ",")))
        assert view.apply(changes, batch) and not view.apply(changes, batch)  # again after a restart
        view = V.MaterializedView.open(spark, f"{tmp_path}/v")
        assert shown(view) == from_scratch(held.values())
    view.merge()
    assert shown(view) == from_scratch(held.values()) and len(view._state()["segments"]) == 1
    view.apply(V.signed(spark.createDataFrame(list(held.values()), KIND), None))
    assert view.read().count() == 0


def test_refresh_reads_only_changes(spark, tmp_path):
    source = spark.createDataFrame([(i, "a", 1, 1.0, "t") for i in range(10)], KIND)
    source.write.parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base")
    view = V.MaterializedView.create(base, f"{tmp_path}/v", ["g"], [V.Aggregate("n", "COUNT")])
    assert not any("/base/" in f for f in view.read().inputFiles())
    for k in range(V.MERGE_AT):
        view.later(V.signed(None, source.limit(1)))
        assert view.refresh() == 1 and view.refresh() == 0
    assert view.read().first().n == 10 + V.MERGE_AT and len(view._state()["segments"]) < 3
    with pytest.raises(ValueError):
        V.Aggregate("m", "MEDIAN", "x")


def people(spark):
    return PropertyGraph().with_nodes("P", spark.createDataFrame([(f"{i}", f"n{i}", i % 3, float(i)) for i in range(12)], "id string, name string, g int, x double"))


def test_statements_on_views(spark):
    s = Session(spark, people(spark))
    s.run("CREATE MATERIALIZED VIEW v AS SELECT g, COUNT(*) AS n, SUM(x) AS s FROM P WHERE x > 1 GROUP BY g REFRESH EVERY 5 MINUTES")
    s.run("CREATE MATERIALIZED CONTEXT VIEW w AS SELECT g, x FROM P WHERE x >= 10 ORDER BY x REFRESH ON chunk_delete")
    s.run("CREATE MATERIALIZED VIEW e AS SELECT g, MAX(x) AS m FROM P GROUP BY g REFRESH ON chunk_insert")
    of = lambda name: sorted(map(tuple, s.run(f"SELECT * FROM {name}").collect()))
    assert of("v") == [(0, 3, 18.0), (1, 3, 21.0), (2, 4, 26.0)] and of("w") == [(1, 10.0), (2, 11.0)]
    now = datetime(2024, 1, 1)
    assert s.tick(now) == []
    s.run("UPDATE NODE P SET x = 100 WHERE x = 4; DELETE NODE P WHERE x = 11; CREATE NODE P {id: 'new', name: 'n', g: 7, x: 50}")
    assert of("v") == [(0, 3, 18.0), (1, 3, 21.0), (2, 4, 26.0)]  # not yet
    assert of("w") == [(1, 10.0), (1, 100.0)]  # refreshed by the deletion, not by what came after
    assert of("e") == [(0, 9.0), (1, 100.0), (2, 8.0), (7, 50.0)]
    assert s.tick(now + timedelta(minutes=4)) == [] and s.tick(now + timedelta(minutes=5)) == ["v"]
    assert of("v") == [(0, 3, 18.0), (1, 3, 117.0), (2, 3, 15.0), (7, 1, 50.0)]
    assert len(s.run("REFRESH MATERIALIZED VIEW w").collect()) == 3
    s.run("DROP MATERIALIZED VIEW w")
    for bad in ("REFRESH MATERIALIZED VIEW w", "CREATE MATERIALIZED VIEW z AS SELECT g FROM P REFRESH ON sunrise", "CREATE MATERIALIZED VIEW z AS SELECT g FROM P REFRESH EVERY 2 WEEKS"):
        with pytest.raises(Unsupported):
            s.run(bad)


def test_sparse_index_after_deltas(spark, tmp_path):
    words = ["storm", "storms", "river", "rivers", "falling", "camelCase", "the", "sea"]
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(9))) for i in range(40)} | {40: None, 41: ""}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id int, text string")
    queries = spark.createDataFrame([(1, "storm river"), (2, "falling camel case"), (3, "nothing here"), (4, "")], "query_id int, text string")
    index = SparseIndex.create(frame(texts), f"{tmp_path}/i", ["text"])

    def same():
        docs = frame(texts)
        want = search.bm25(queries, search.postings(docs, ["text"]), docs)
        rows = lambda df: sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())
        assert rows(index.bm25(queries)) == rows(want) != []

    same()
    new = {i: f"storm rivers {i}" for i in range(35, 45)}
    texts |= new
    index.update(frame(new), frame({0: "", 1: ""}))
    texts.pop(0), texts.pop(1)
    same()
    index.update(None, frame({2: "", 36: "", 999: ""}))
    texts.pop(2), texts.pop(36)
    same()
    index.merge()
    same()
    assert len(index.state()["segments"]) == 1 and index.state()["n_docs"] == len(texts)
    plan = index.postings().filter(F.col("term").isin(["storm", "river"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    with pytest.raises(FileNotFoundError):
        SparseIndex(spark, f"{tmp_path}/none").state()


def test_catalogue_across_sessions(spark, tmp_path):
    g = graph_of_tables(spark, SF)
    first = Session(spark, g, catalogue=IndexCatalogue(spark, f"{tmp_path}/c"))
    plain = first.run("SPARSE SEARCH 'the sea of stones' IN Document LIMIT 5").collect()
    first.run("CREATE INDEX words ON Document (text) TYPE SPARSE; CREATE INDEX dates ON Order (o_orderdate, o_custkey) TYPE COMPOSITE")
    second = Session(spark, g, catalogue=IndexCatalogue(spark, f"{tmp_path}/c"))
    assert [(r.name, r.type) for r in second.run("SHOW INDEXES").collect()] == [("dates", "COMPOSITE"), ("words", "SPARSE")]
    found = second.run("SPARSE SEARCH 'the sea of stones' IN Document LIMIT 5")
    assert [(r.id, round(r.score, 6)) for r in found.collect()] == [(r.id, round(r.score, 6)) for r in plain]
    assert not any("documents.parquet" in f for f in found.inputFiles())
    bounded = second.run("SELECT o_orderkey FROM Order WHERE o_orderdate > '2001-01-01'")
    assert all("/dates-" in f for f in bounded.inputFiles())
    assert bounded.count() == second.run("SELECT o_orderkey, o_orderdate FROM Order").filter("o_orderdate > '2001-01-01'").count()
    second.run("UPDATE NODE Order SET o_orderstatus = 'X' WHERE o_orderkey < 10; CREATE NODE Document {id: 'D:new', text: 'zyzzyva zyzzyva'}")
    assert second.run("SPARSE SEARCH 'zyzzyva' IN Document").first().id == "D:new"  # taken in
    assert not any("/dates-" in f for f in second.run("SELECT o_orderkey FROM Order WHERE o_orderdate > '2001-01-01'").inputFiles())  # stale
    second.run("DROP INDEX dates")
    assert [r.name for r in first.run("SHOW INDEXES").collect()] == ["words"]
    for bad in ("CREATE INDEX v ON Document (text) TYPE VECTOR", "CREATE INDEX v ON Document (nothing) TYPE SPARSE"):
        with pytest.raises(Unsupported):
            first.run(bad)


def test_point_lookup_reads_one_table(spark):
    s = Session(spark, graph_of_tables(spark, SF))
    found = s.run("FIND BY UUID 'C:7'")
    assert [tuple(r)[:2] for r in found.collect()] == [("C:7", "Customer")]
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,7)" in plan and "part.parquet" not in plan
    assert s.run("FIND BY UUID 'T:7:1'").first().label == "Turn"
    for none in ("C:x", "C:7:8", "Z:1", "", "C:99999999999999999999"):
        assert s.run(f"FIND BY UUID '{none}'").count() == 0
    s.run("CREATE NODE Customer {id: 'mine', name: 'm'}")
    assert s.run("FIND BY UUID 'mine'").first().name == "m" and s.run("FIND BY UUID 'C:7'").count() == 1


def test_packed_postings_are_those_of_the_rows(spark, monkeypatch):
    """Counted in the documents, dealt by stem: no row a document and pair is shuffled; lists and batches that are full go on."""
    from weftgraph.operators import search

    texts = ["sea sand sea sand sea", "sand", None, "", "the", "sea of sand and of sea", "ab__cd x9 x sea"] + ["sea sand stone"] * 9
    rows = [(10 * i, t, "sea wind" if i % 3 else None) for i, t in enumerate(texts)]
    held = search.stemmed(spark.createDataFrame(rows, "id long, text string, name string").coalesce(1), ["text", "name"])
    as_set = lambda df: sorted(map(tuple, df.select("term", "id", "tf", "terms").collect()))
    want = as_set(search.counted(held, ["text", "name"]))
    for listed, counted in ((64, 2_000_000), (4, 2_000_000), (64, 7), (1, 1)):
        monkeypatch.setattr(search, "LISTED", listed)
        monkeypatch.setattr(search, "COUNTED", counted)
        blocks = search.packed(held, ["text", "name"])
        assert as_set(search.unpacked(blocks)) == want
        assert max(len(r.ids) for r in blocks.collect()) <= listed
    monkeypatch.undo()
    assert blocks.count() > 3 * search.packed(held, ["text", "name"]).count()
    assert search.packed(held.limit(0), ["text", "name"]).count() == 0
