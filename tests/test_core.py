"""Hand-made cases of the reference's operators: small graphs, ties, nulls, empty input."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.lang import Session
from weftgraph.lang.parser import Unsupported, parse
from weftgraph.operators import analytics as A
from weftgraph.operators import chunking
from weftgraph.operators import search as R
from weftgraph.operators import textops as T
from weftgraph.operators import traverse as G
from weftgraph.operators import versions as V
from weftgraph.operators.graph import Edges, PropertyGraph


@pytest.fixture(scope="module")
def people(spark):
    nodes = spark.createDataFrame([("a", "Ann", 30, "x"), ("b", "Bob", 40, "x"), ("c", "Cy", None, "y"), ("d", "Di", 50, None)], "id string, name string, age int, team string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0)], "source string, target string, weight double")
    return PropertyGraph({"Person": nodes}, {"KNOWS": Edges(edges, "Person", "Person")})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_group_by_and_nulls(spark, people):
    out = Session(spark, people).run("SELECT team, COUNT(*) AS n, AVG(age) AS mean, SUM(age) AS total FROM Person GROUP BY team")
    assert rows(out, "team", "n", "mean", "total") == sorted([("x", 2, 35.0, 70.0), ("y", 1, 0.0, 0.0), (None, 1, 50.0, 50.0)], key=str)
    out = Session(spark, people).run("AGGREGATE AVG(age) FROM Person GROUP BY team")
    assert rows(out, "team", "value") == [("unknown", 50.0), ("x", 35.0), ("y", 0.0)]


def test_comparisons(spark, people):
    run = lambda w: [r[0] for r in rows(Session(spark, people).run(f"SELECT id FROM Person WHERE {w}"), "id")]
    assert run("age = '30'") == ["a"] and run("age != 30") == ["b", "c", "d"] and run("age > 'x'") == []
    assert run("NOT age > 35") == ["a", "c"] and run("age IS NULL OR name = 'Di'") == ["c", "d"]
    assert run("name CONTAINS 'B' AND NOT (age = 1)") == ["b"] and run("team NOT IN ('x')") == ["c", "d"]


def test_traverse_and_paths(spark, people):
    out = Session(spark, people).run("TRAVERSE FROM Person WHERE name = 'Ann' VIA KNOWS TO Person MAX DEPTH 2")
    assert rows(out, "id", "distance") == [("b", 1), ("c", 2)]
    path = Session(spark, people).run("SHORTEST_PATH FROM 'd' TO 'a'")
    assert [r.id for r in path.orderBy("step").collect()] == ["d", "c", "b", "a"]
    assert Session(spark, people).run("SHORTEST_PATH FROM 'd' TO 'a' MAX_DEPTH 2").count() == 0
    assert G.reachable(people.all_edges(), people.scan("Person").limit(0), 3).count() == 0
    b = {r.id: r.betweenness for r in G.betweenness(people.all_edges(), people.scan("Person").select("id")).collect()}
    assert b == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}


def test_pagerank_and_components(spark, people):
    got = {r.id: r["rank"] for r in G.pagerank_undirected(people.all_edges(), people.scan("Person"), 0.85, 30).collect()}
    near = {"a": ["b"], "b": ["a", "c"], "c": ["b", "d"], "d": ["c"]}
    want = dict.fromkeys(near, 0.25)
    for _ in range(30):
        want = {n: 0.15 / 4 + 0.85 * sum(want[m] / len(near[m]) for m in near[n]) for n in near}
    assert all(got[n] == pytest.approx(want[n]) for n in near)
    lonely = people.scan("Person").select("id").union(spark.createDataFrame([("z",)], "id string"))
    assert {r.component for r in G.components(people.all_edges(), lonely).collect()} == {"a", "z"}


def test_writes(spark, people):
    s = Session(spark, people)
    s.run("CREATE NODE Person {id: 'e', name: 'Ed', age: 9}; CREATE EDGE KNOWS FROM 'd' TO 'e'; UPDATE NODE Person SET {age: 10} WHERE name = 'Ed'; DELETE NODE Person WHERE name = 'Cy'")
    assert rows(s.run("SELECT id, age FROM Person"), "id", "age") == sorted([("a", 30), ("b", 40), ("d", 50), ("e", 10)], key=str)
    assert rows(s.run("SELECT EDGE"), "source", "target") == [("a", "b"), ("d", "e")]
    assert people.scan("Person").count() == 4  # the graph it began with is as it was
    with pytest.raises(ValueError):
        V.checked_update(people.scan("Person").withColumn("version", F.lit(2)), F.lit(True), 1, {"age": F.lit(1)})


def test_unsupported_statements():
    for text in ("BEGIN TRANSACTION", "SELECT FROM", "MATCH (a:X)-[R]->", "??"):
        with pytest.raises(Unsupported):
            parse(text)


def test_explain(spark, people):
    assert "Physical Plan" in Session(spark, people).run("EXPLAIN SELECT id FROM Person WHERE age > 3")


def test_tokens(spark):
    texts = ["graphNodes UIContext running classes queries", "the of", "", None, "a-b_c/d", "indexed news bus"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.tokens(F.col("t")), X.pairs_of(X.tokens(F.col("t")))).collect()
    assert got[0][0] == ["graph", "node", "ui", "context", "runn", "classe", "query"]
    assert got[0][1][0] == "graph__node" and len(got[0][1]) == 6
    assert [g[0] for g in got[1:5]] == [[], [], [], []] and got[5][0] == ["index", "new", "bus"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple cherry"), (3, "")], "id long, text string")
    got = {r.id: r.score for r in R.bm25(spark.createDataFrame([(0, "apple")], "query_id long, text string"), R.postings(docs, ["text"]), docs).collect()}
    idf, mean = math.log((3 - 2 + 0.5) / 2.5 + 1), 4 / 3
    assert got == {i: pytest.approx(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 2 / mean))) for i, tf in ((1, 1), (2, 2))}



def test_camel_case_by_groups(spark):
    import re

    texts = ["aBcD", "ABcDEf", "XMLHttpRequest", "aBC", "ABC", "abC dEF GHi", "éB Éa", "A", "aAaAAaa", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.tokens(F.col("t")).alias("w")).collect()
    for r in got:
        apart = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", texts[r.i] or "").lower().split()
        assert [w for w in apart if len(w) > 1 and w not in X.STOP_WORDS] == r.w


def test_bm25_scan_is_bm25(spark):
    docs = [(1, "Apple Pie", "apple banana pie"), (2, "", "apple apple cherry"), (3, None, None), (4, "cherry apple", "nothing here")]
    docs = spark.createDataFrame(docs, "id long, title string, text string")
    queries = spark.createDataFrame([(0, "apple pie"), (1, "cherry"), (2, "unknown"), (3, None)], "query_id long, text string")
    kept = {(r.query_id, r.id): r.score for r in R.bm25(queries, R.postings(docs, ["title", "text"]), docs).collect()}
    scanned = {(r.query_id, r.id): r.score for r in R.bm25_scan(queries, docs, ["title", "text"]).collect()}
    assert kept and scanned == {k: pytest.approx(v) for k, v in kept.items()}
    words = {(r.query_id, r.id): r.score for r in R.keyword_score(queries, docs, {"title": 2.0, "text": 1.0}).collect()}
    assert words == {(0, 1): 6.0 * 4 / 2, (0, 2): 1.0 / 2, (0, 4): 2.0 / 2, (1, 2): 1.0, (1, 4): 2.0}
    assert R.bm25_scan(queries, docs.limit(0), ["text"]).count() == 0 and R.keyword_score(queries.limit(0), docs, {"text": 1.0}).count() == 0


def test_rrf_mmr_metrics(spark):
    one = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, id long, rank int")
    two = spark.createDataFrame([(0, 2, 1)], "query_id long, id long, rank int")
    got = {r.id: (r.score, r.signals) for r in R.rrf({"a": one, "b": two}).collect()}
    assert got == {1: (1 / 61, 1), 2: (pytest.approx(1 / 62 + 1 / 61), 2)}
    ranked = spark.createDataFrame([(0, "x", 9.0, "red fox runs"), (0, "y", 8.0, "red fox runs"), (0, "z", 1.0, "blue whale")], "query_id long, id string, score double, text string")
    assert [r.id for r in R.mmr(ranked, 3).orderBy("place").collect()] == ["x", "z"]


def test_windows_and_joins(spark):
    t = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:59:59"), (3, "2024-01-01 02:00:00")], "id int, s string").withColumn("ts", F.to_timestamp("s"))
    got = A.range_join(t.select(F.col("id").alias("a"), F.col("ts").alias("ta")), t.select(F.col("id").alias("b"), F.col("ts").alias("tb")), "ta", "tb", 3601)
    assert rows(got, "a", "b") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3)]
    s = spark.createDataFrame([("k", d, v) for d, v in enumerate([1, 9, 1, 9, 9])] + [("l", 0, 1)], "k string, d int, v int")
    assert rows(A.streak(s, "k", "d", F.col("v") > 5), "k", "streak") == [("k", 2), ("l", 0)]
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    assert rows(flat.groupBy("g").agg(A.pearson("x", "y").alias("r")), "g", "r") == [("a", 0.0), ("b", 0.0)]


def test_duplicates(spark):
    ids = spark.createDataFrame([(i,) for i in range(5)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert rows(T.first_come(ids, pairs), "id", "kept") == [(0, True), (1, False), (2, True), (3, True), (4, False)]
    t = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "ab"), (4, "")], "id long, t string").transform(lambda df: T.with_simhash(df, "t"))
    got = {r.id: (r.hi, r.lo) for r in t.collect()}
    import hashlib

    words = "one two three four five six".split()
    hashes = [int(hashlib.md5(" ".join(words[i : i + 3]).encode()).hexdigest(), 16) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert got[1] == got[2] == (want >> 32, want & 0xFFFFFFFF)


def test_masks(spark):
    df = spark.createDataFrame([("mail ann.lee@x.org or 123-45-6789, 999.1.1.1, 4111 1111 1111 1111",), (None,), ("",)], "text string")
    got = T.pii_scan(df).collect()
    assert (got[0].n_email, got[0].n_ssn, got[0].n_ip_address, got[0].n_credit_card, got[0].sensitivity) == (1, 1, 0, 1, "restricted")
    assert got[1].sensitivity == got[2].sensitivity == "public"
    assert df.select(T.pii_masked(F.col("text"))).first()[0].startswith("mail a***e@x.org or ***-6789")
    assert "[EMAIL REDACTED]" in df.select(T.pii_redacted(F.col("text"))).first()[0]


def test_chunks(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), ("abc",)], "t string")
    got = [[(c.text, c.start, c.end) for c in r[0]] for r in df.select(T.chunk_fixed(F.col("t"), 4, 1)).collect()]
    assert got == [[("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10)], [], [("abc", 0, 3)]]
    text = "# A\n\nOne two. Three four! Five?\n\nBob: hi there\nAnn: yes\nmore\n\n## B\n" + "word " * 40
    for work in chunking.STRATEGIES.values():
        found = list(work(text, 30, 10))
        assert found and all(0 <= a < b <= len(text) for _, a, b in found) and not list(work("", 30, 10))
    assert list(chunking.fixed(text, 30, 10))[-1][2] == len(text)


def test_html_and_dates(spark):
    df = spark.createDataFrame([("<html><head><title>x</title></head><body><p>A &amp; B</p><script>no()</script>c<br>d</body></html>", "On March 31, 2021 or 2020-02-05")], "h string, t string")
    text, (day, sure) = T.html_text(F.col("h")), T.event_date(F.col("t"))
    r = df.select(text, day.cast("string"), sure).first()
    assert tuple(r) == ("A & B\nc\nd", "2020-02-05", 0.95)


def test_rules_from_text(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 6.0), ("b", 1.0)], "g string, v double")
    found = A.engine(A.load_rules("- {name: r, kind: sum, compare: gt, threshold: 10, value: v, group: g}"), df)
    assert rows(found, "rule", "subject", "value") == [("r", "a", 11.0)]


def test_files(spark, tmp_path):
    from weftgraph.sources import readers

    (tmp_path / "x.csv").write_text("skip me\na;b\n1;2\n3;4\n")
    got = readers.read_csv(spark, f"{tmp_path}/x.csv", ";", skip_rows=1)
    assert rows(got, "a", "b") == [("1", "2"), ("3", "4")]
    (tmp_path / "t.nt").write_text('<u:a> <u:p> <u:b> .\n<u:a> <u:name> "Ann \\"x\\""@en .\nbad\n')
    assert rows(readers.triples(spark, f"{tmp_path}/t.nt"), "subject", "object", "literal")[0] == ("u:a", "u:b", None)
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="n1"><data key="k">v</data></node><node id="n2"/><edge source="n1" target="n2"/></graph></graphml>')
    nodes, edges = readers.graphml(spark, f"{tmp_path}/g.graphml")
    assert rows(nodes, "id") == [("n1",), ("n2",)] and rows(edges, "source", "target") == [("n1", "n2")]


def test_approximate_vectors_reach_the_recall(spark):
    import random

    from weftgraph.operators import search

    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(64)]) for k in range(400)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = vectors.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in search.cosine_top(queries, vectors, 5).collect()}
    found = {(r.query_id, r.id) for r in search.lsh_top(queries, vectors, 5, 6, 64).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_keywords_as_labels(spark):
    from weftgraph.lang import Session
    from weftgraph.operators.graph import graph_of_tables

    s = Session(spark, graph_of_tables(spark, "/root/testdata/sf0.001"))
    rows = s.run("MATCH NODE Order WHERE NOT (o_totalprice > 50000) RETURN Order.id AS id, o_totalprice ORDER BY o_totalprice LIMIT 3")
    assert rows.columns == ["id", "o_totalprice"] and rows.count() == 3


def test_near_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    for f in prints[:60]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, 9)):
                f ^= 1 << b
            prints.append(f)
    rows = [(k, f >> 32, f & 0xFFFFFFFF) for k, f in enumerate(prints)]
    first = {f: k for k, f in reversed(list(enumerate(prints)))}
    want = sorted((a, b, (prints[a] ^ prints[b]).bit_count()) for a in first.values() for b in first.values() if a < b and (prints[a] ^ prints[b]).bit_count() <= 6)
    assert rows_of(T.near_pairs(spark.createDataFrame(rows, "id long, hi long, lo long"))) == want


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_tiers_against_percent_rank(spark):
    from pyspark.sql import Window as W

    held = [(k, None if k % 23 == 0 else float((k * k) % 37), "a word " * 60) for k in range(300)]
    for some in (held, held[:1], held[1:2], []):
        df = spark.createDataFrame(some, "id long, s double, text string")
        r = F.percent_rank().over(W.orderBy("s"))
        want = df.select("id", F.when(r >= 0.7, "full").when(r >= 0.4, "summary").when(r >= 0.1, "reference").otherwise("dropped"))
        got = T.compressed(df, "s", "text")
        assert rows_of(got.select("id", "tier")) == rows_of(want)
        assert got.columns == ["id", "s", "text", "tier", "summary"]


def test_streams_to_files(spark, tmp_path):
    from weftgraph.streaming import streams

    for n, part in enumerate([[("a", 1), ("b", 2)], [("a", 3)]]):
        spark.createDataFrame(part, "k string, v long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema("k string, v long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert rows_of(streams.to_table(source.groupBy("k").agg(F.sum("v").alias("v")), f"{tmp_path}/sums")) == [("a", 4), ("b", 2)]
    assert rows_of(streams.to_table(source, f"{tmp_path}/all", "append")) == [("a", 1), ("a", 3), ("b", 2)]


def test_whole_files(spark, tmp_path):
    """A file is one row however many lines it has."""
    from weftgraph.sources import readers

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "b.txt").write_text("three")
    assert sorted(r.text for r in readers.read_folder(spark, f"{tmp_path}/in").collect()) == ["one\ntwo\n", "three"]
    (tmp_path / "x.jsonld").write_text('[\n{"@id": "a", "knows": {"@id": "b"},\n "name": "A"},\n{}]')
    assert rows_of(readers.jsonld(spark, f"{tmp_path}/x.jsonld")) == [("a", "knows", "b"), ("a", "name", "A")]
