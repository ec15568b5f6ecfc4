"""The combined search against a plain version of its steps, for every query of the benchmark table."""

from collections import defaultdict

from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import hybrid
from weftgraph.operators import search as R
from weftgraph.plans import hybrids
from weftgraph.plans.graphs import corpus, kept_index
from weftgraph.plans.registry import CATALOG

SF = "/root/testdata/sf0.001"


def plain(stems, node, stems_of, scored, edges, near, fuzzy, limit=10):
    """One query. scored and fuzzy: (id, score); edges: id -> [(type, target)]; near: id -> ids."""
    found = sorted(scored, key=lambda r: (-r[1], r[0]))[: 3 * limit]
    if not found:
        return []
    longer = {t for t in stems if len(t) > 3}
    enough = [r for r in found if len(longer & stems_of[r[0]]) >= max(1, len(longer) // 2)]
    found = sorted(enough, key=lambda r: (-len(stems & stems_of[r[0]]), -r[1], r[0])) if enough else found[:limit]
    expanded = {}
    for i, _ in found[:5]:
        for kind, target in sorted(edges[i])[:10]:
            if target in node and node[target]["name"] and node[target]["name"] not in expanded:
                expanded[node[target]["name"]] = (target, kind)
    names, close = {node[i]["name"].lower() for i, _ in found}, []
    for i, _ in found[:3]:
        for j in near.get(i, [])[:3]:
            if j in node and node[j]["label"] == "Document" and node[j]["name"].lower() not in names:
                names.add(node[j]["name"].lower())
                close.append(j)
    out, seen = [], set()

    def add(i, name, score, via):
        key = name.strip(" ").lower()[:60]
        if key not in seen:
            seen.add(key)
            out.append((i, score, via))

    for i, s in found:
        add(i, node[i]["name"], s, "bm25")
    for name, (target, kind) in list(expanded.items())[:5]:
        if len(name) > 3:
            add(target, name, 0.3, f"connected ({kind})")
    for j in close:
        add(j, node[j]["name"], 0.1, "semantic_neighbor")
    for i, s in sorted(fuzzy, key=lambda r: (-r[1], r[0]))[:limit]:
        add(i, node[i]["name"], s * 0.5, "fuzzy_match")
    return out[:limit]


def test_combined_search(spark):
    docs, queries = corpus(spark, SF)
    nodes, edges = hybrids.linked(spark, SF)
    stems = X.tokens(F.concat_ws(" ", "name", "snippet"))
    node = {r.id: {"name": r["name"], "label": r.label, "stems": set(r.stems)} for r in nodes.withColumn("stems", stems).collect()}
    out = defaultdict(list)
    for r in edges.collect():
        out[r.source].append((r.type, r.target))
    scored, fuzzy = defaultdict(list), defaultdict(list)
    for r in kept_index(spark, SF).bm25(queries).collect():
        scored[r.query_id].append((f"D:{r.id}", round(r.score, 7)))
    for r in R.fuzzy(queries, docs, 0.7).collect():
        fuzzy[r.query_id].append((f"D:{r.id}", r.similarity))
    near = defaultdict(list)
    for r in hybrids.near(spark, SF)(nodes.select("id")).orderBy("id", "rank").collect():
        near[r.id].append(r.near)
    got = defaultdict(list)
    for r in CATALOG["combined_search"].run(spark, SF).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.id, r.score, r.via))
    asked = queries.withColumn("stems", X.tokens(F.col("text"))).collect()
    for r in asked:
        want = plain(set(r.stems), node, {i: n["stems"] for i, n in node.items()}, scored[r.query_id], out, near, fuzzy[r.query_id])
        assert [(i, v) for i, _, v in got[r.query_id]] == [(i, v) for i, _, v in want], r.query_id
        assert all(abs(a[1] - b[1]) < 1e-4 for a, b in zip(got[r.query_id], want, strict=True))
    assert {v.split(" ")[0] for g in got.values() for *_, v in g} >= {"bm25", "connected"}


def test_small_cases(spark):
    nodes = spark.createDataFrame([("a", "Document", "storm river", "x"), ("b", "Document", "Storm River ", "y"), ("c", "Note", "quiet", ""), ("e", "Entity", "harbour", ""), ("f", "Entity", "abc", ""), ("g", "Entity", None, "")], "id string, label string, name string, snippet string")
    edges = spark.createDataFrame([("a", "e", "T"), ("a", "f", "T"), ("a", "g", "T"), ("a", "nowhere", "T"), ("e", "c", "T")], "source string, target string, type string")
    queries = spark.createDataFrame([(1, "storm rivers"), (2, "nothing"), (3, None)], "query_id int, text string")
    bm25 = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "query_id int, id string, score double")
    fuzzy = spark.createDataFrame([(1, "c", 0.6), (2, "c", 0.9)], "query_id int, id string, similarity double")
    near = lambda ids: ids.select("id", F.lit("c").alias("near"), F.lit(1).alias("rank"))
    got = hybrid.combined(queries, nodes, bm25, edges, near, fuzzy, 10, ["Document"]).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.id, r.via) for r in got] == [(1, "b", "bm25"), (1, "e", "connected (T)"), (1, "c", "fuzzy_match")]
    signal = hybrid.entity_signal(spark.createDataFrame([(1, "(Harbour) of"), (2, "ab")], "query_id int, text string"), nodes, edges, 5)
    assert [tuple(r) for r in signal.collect()] == [(1, "c", 1)]
    ranks = lambda *r: spark.createDataFrame(list(r), "query_id int, id string, rank int")
    out = hybrid.agreed({"x": ranks((1, "c", 1), (1, "a", 2)), "y": ranks((1, "c", 1), (1, "a", 9)), "z": ranks((1, "e", 1))}, nodes, 15).orderBy("place").collect()
    assert [(r.id, r.signals, r.names) for r in out] == [("a", 2, "x,y"), ("c", 2, "x,y"), ("e", 1, "z")]  # a source comes before a note
