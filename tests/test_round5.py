"""Steps that took time or space in proportion to more than their input's words."""

import random
from hashlib import md5

from pyspark.sql import functions as F

from weftgraph.operators import search, textops


def test_fingerprints_are_votes_of_md5(spark, monkeypatch):
    monkeypatch.setattr(textops, "VOTED", 40)
    rng = random.Random(3)
    texts = [None, "", " ", "a", "ab c", "\tTwo words ", "É 😀"] + [" ".join(rng.choice(["Sea", "moon", "über", "\n", "😀"]) for _ in range(rng.randrange(1, 90))) for _ in range(40)]

    def halves(text):
        low = "".join(c if c not in "\t\n" else " " for c in (text or "").strip(" ").lower())
        words = low.split()
        parts = words if len(words) > 2 else list(" ".join(low.split(" ")) if "  " not in low else __import__("re").sub(" +", " ", low))
        grams = [md5(" ".join(parts[k : k + 3]).encode()).hexdigest() for k in range(max(1, len(parts) - 2))]
        vote = lambda at: sum(1 << b for b in range(32) if 2 * sum(int(g[at : at + 8], 16) >> b & 1 for g in grams) > len(grams))
        return vote(16), vote(24)

    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    marked = textops.with_simhash(docs)
    assert {r.id: (r.hi, r.lo) for r in marked.collect()} == {k: halves(t) for k, t in enumerate(texts)}
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "md5(" not in plan


def test_a_scan_writes_no_stems(spark, monkeypatch):
    rows = [(k, f"t{k}", " ".join(f"word{k * 50 + j}" for j in range(50)) + (" harbour light" if k % 9 == 0 else "")) for k in range(60)] + [(99, None, None)]
    docs = spark.createDataFrame(rows, "id int, title string, text string")
    queries = spark.createDataFrame([(1, "harbour light"), (2, "nothing there")], "query_id int, text string")
    cells, cut = [], search.cut

    def counted(df):
        out = cut(df)
        lists = [F.size(f.name) for f in out.schema.fields if f.dataType.typeName() == "array"]
        cells.append(out.select(sum(lists, F.lit(1)).alias("n")).agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(search, "cut", counted)
    got = {(r.query_id, r.id): round(r.score, 9) for r in search.bm25_scan(queries, docs, ["title", "text"]).collect()}
    kept = {(r.query_id, r.id): round(r.score, 9) for r in search.bm25(queries, search.postings(docs, ["title", "text"]), docs).collect()}
    assert got == kept and len(got) == 7
    assert max(cells) <= 61 + 3 * 7


def test_paired_items_are_dealt_by_their_number(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    from weftgraph.operators import analytics

    monkeypatch.setattr(analytics, "PAIRED", 100)
    rng = random.Random(5)
    rows = [(rng.randrange(200), rng.randrange(20)) for _ in range(1500)] + [(None, 1), (None, 2), (3, None)]
    got = analytics.cooccurrence(spark.createDataFrame(rows, "g int, i int"), "g", "i", 2)
    held = {g: {i for h, i in rows if h == g and i is not None} for g in range(200)}
    want = Counter(p for s in held.values() for p in combinations(sorted(s), 2))
    assert {(r.a, r.b): r.weight for r in got.collect()} == {p: n for p, n in want.items() if n >= 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and ", 16), REPARTITION_BY_NUM" in plan


def test_a_walk_takes_a_bounded_number_of_edges_of_a_node(spark, monkeypatch):
    from weftgraph.operators import paths

    plans, cut = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    edges = spark.createDataFrame([("hub", f"n{k:03}", "A") for k in range(300)] + [(f"s{k}", "hub", "B") for k in range(5)], "source string, target string, type string")
    nodes = spark.createDataFrame([("hub", "Note", 1)] + [(f"n{k:03}", "Note", 2) for k in range(300)] + [(f"s{k}", "Note", 1) for k in range(5)], "id string, label string, cost int")
    got = paths.budgeted(edges, nodes, spark.createDataFrame([(k, f"s{k}", 1) for k in range(5)], "query_id int, id string, place int"), 2, 12).collect()
    assert {q: [r.id for r in sorted(got, key=lambda r: r.place) if r.query_id == q] for q in range(5)} == {q: [f"s{q}", "hub", *(f"n{k:03}" for k in range(5))] for q in range(5)}
    assert any("WindowGroupLimit [source" in p for p in plans)
