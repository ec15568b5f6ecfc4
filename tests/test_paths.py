"""Paths against plain queues and walks over small random graphs."""

import random
from collections import deque

from pyspark.sql import functions as F

from weftgraph.lang import Session
from weftgraph.operators import paths
from weftgraph.operators.graph import Edges, PropertyGraph

KIND = "source string, target string, type string, weight double, decay double"


def graph(seed, n=12, m=40):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("AB")): (rng.choice([0.5, 0.9, 1.0, 2.0]), rng.choice([0.0, 0.1, 0.3])) for _ in range(m)}
    return [(*k, *v) for k, v in edges.items()]


def queue_of(edges, start, value, hops, least):
    """A queue, with a node's edges by type and end."""
    out, visited, queue = {}, {start}, deque()

    def push(node, strength, hop, path):
        for s, t, kind, w, d in sorted(edges, key=lambda e: (e[2], e[1])):
            if s == node and t not in visited and strength * w * (1 - d) >= least:
                queue.append((t, strength * w * (1 - d), hop + 1, [*path, t]))

    push(start, abs(value), 0, [start])
    while queue:
        node, strength, hop, path = queue.popleft()
        if node in visited:
            continue
        visited.add(node)
        out[node] = (round(strength, 4), hop, path)
        if hop < hops:
            push(node, strength, hop, path)
    return out


def test_impact_is_that_of_a_queue(spark):
    for seed in range(4):
        edges = graph(seed)
        df = spark.createDataFrame(edges, KIND)
        sources = spark.createDataFrame([("n0", -0.8), ("n1", 1.0), ("nowhere", 1.0)], "id string, value double")
        got = {(r.start, r.id): (round(r.strength, 3), r.hops, list(r.path)) for r in paths.impact(df, sources).collect()}
        want = {(s, k): (round(v[0], 3), *v[1:]) for s, x in (("n0", -0.8), ("n1", 1.0)) for k, v in queue_of(edges, s, x, 3, 0.1).items()}
        assert got == want
    assert paths.impact(df.limit(0), sources).count() == 0


def test_what_if(spark):
    edges = graph(7)
    gone, new = edges[0], ("n0", "n5", "C", 1.0, 0.0)
    changed = spark.createDataFrame([(*gone, True), (*new, False)], f"{KIND}, removed boolean")
    sources = spark.createDataFrame([("n0", 1.0)], "id string, value double")
    got = {r.id: (round(r.before, 3), round(r.after, 3)) for r in paths.what_if(spark.createDataFrame(edges, KIND), changed, sources).collect()}
    before, after = queue_of(edges, "n0", 1.0, 3, 0.1), queue_of([e for e in edges if e != gone] + [new], "n0", 1.0, 3, 0.1)
    pairs = {k: (round(before.get(k, (0.0,))[0], 3), round(after.get(k, (0.0,))[0], 3)) for k in before.keys() | after.keys()}
    assert got == {k: v for k, v in pairs.items() if v[0] != v[1]} and got


def test_a_signal_spreads_by_direction(spark):
    rng = random.Random(3)
    links = {(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}"): (rng.choice([0.5, 0.9, 1.0]), rng.random() < 0.3) for _ in range(22)}
    links = [(a, b, *v) for (a, b), v in links.items() if a != b]
    df = spark.createDataFrame(links, "source string, target string, weight double, lateral boolean")

    def near(node, directions):
        for name in directions:
            if name == "downstream":
                yield from sorted((b, w, name) for a, b, w, side in links if a == node and not side)
            elif name == "upstream":
                yield from sorted((a, w * 0.5, name) for a, b, w, side in links if b == node and not side)
            else:
                # of two links between the same peers the stronger counts
                yield from sorted(((b if a == node else a, w * 0.7, name) for a, b, w, side in links if node in (a, b) and side), key=lambda r: (r[0], -r[1]))

    for directions in (("downstream", "upstream", "lateral"), ("downstream",), ("upstream", "lateral")):
        want, queue = {}, deque([("n0", 1.0, 0)])
        while queue:
            node, weight, hop = queue.popleft()
            if hop < 4:
                for other, w, name in near(node, directions):
                    if other != "n0" and other not in want and weight * w >= 0.1:
                        want[other] = (round(weight * w, 6), hop + 1, name)
                        queue.append((other, weight * w, hop + 1))
        got = paths.spread(df, spark.createDataFrame([("n0",)], "id string"), 4, 0.1, directions)
        assert {r.id: (round(r.weight, 6), r.hops, r.direction) for r in got.collect()} == want


def test_names_in_texts(spark):
    nodes = spark.createDataFrame([("1", "Crude Oil"), ("2", "crude"), ("3", "Oil"), ("4", None), ("5", ""), ("6", "crude oil")], "id string, name string")
    texts = spark.createDataFrame([(1, "crude oil rises"), (2, "OIL!"), (3, "nothing"), (4, None)], "text_id int, text string")
    assert sorted(map(tuple, paths.named_in(nodes, texts).collect())) == [(1, "1"), (2, "3")]


def trails_of(edges, start, least, most, both):
    out = []

    def walk(node, path, used):
        if least <= len(used) <= most:
            out.append(tuple(path))
        if len(used) < most:
            for k, (s, t, *_) in enumerate(edges):
                for a, b in ((s, t), (t, s)) if both and s != t else ((s, t),):
                    if a == node and k not in used:
                        walk(b, [*path, b], used | {k})

    walk(start, [start], frozenset())
    return sorted(out)


def test_trails_use_no_edge_twice(spark):
    for seed, direction in ((1, "out"), (2, "both"), (3, "both")):
        edges = graph(seed, 5, 9)
        df = spark.createDataFrame(edges, KIND)
        for least, most in ((1, 3), (0, 2), (2, 4)):
            found = paths.trails(df, spark.createDataFrame([("n0",)], "id string"), least, most, direction)
            assert sorted(tuple(r.path) for r in found.collect()) == trails_of(edges, "n0", least, most, direction == "both")
    ordered = [tuple(r.path) for r in paths.by_strategy(found, "DFS").collect()]
    assert ordered == sorted(ordered)
    assert [r.length for r in paths.by_strategy(found, "BFS").collect()] == sorted(r.length for r in found.collect())


def test_lineage_steps(spark):
    df = spark.createDataFrame([("a", "b", "D"), ("a", "c", "D"), ("b", "d", "D"), ("c", "d", "D"), ("d", "a", "D")], "source string, target string, type string")
    rows = sorted(paths.lineage(df, spark.createDataFrame([("a",), ("x",)], "id string")).collect())
    assert [(r.start, r.step, r.depth, r.id) for r in rows] == [("a", 0, 0, "a"), ("a", 1, 1, "b"), ("a", 2, 1, "c"), ("a", 3, 2, "d"), ("x", 0, 0, "x")]
    assert list(rows[3].path) == ["a", "b", "d"]


def test_quantified_patterns_start_where_they_are_bounded(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}", i) for i in range(12)], "id string, name string, k int")
    edges = graph(5)
    links = spark.createDataFrame([(s, t, w) for s, t, kind, w, _ in edges if kind == "A"], "source string, target string, weight double")
    s = Session(spark, PropertyGraph().with_nodes("N", nodes).with_edges("A", Edges(links, "N", "N")))

    def pairs(least, most):
        step = {(a, b) for a, b, kind, *_ in edges if kind == "A"}
        reach, level = set(), {(f"n{i}", f"n{i}") for i in range(12)}
        if least == 0:
            reach |= level
        for n in range(1, most + 1):
            level = {(a, d) for a, b in level for c, d in step if b == c}
            reach |= level if n >= least else set()
        return reach

    for text, least, most in (("+", 1, 5), ("*1..3", 1, 3), ("{2,4}", 2, 4), ("{,2}", 0, 2)):
        got = s.run(f"MATCH (a:N)-[A{text}]->(b:N) WHERE a.k < 3 RETURN a.id AS a, b.id AS b").collect()
        assert sorted(map(tuple, got)) == sorted(p for p in pairs(least, most) if int(p[0][1:]) < 3), text
        got = s.run(f"MATCH (a:N)-[A{text}]->(b:N) WHERE b.k = 4 RETURN a.id AS a, b.id AS b").collect()
        assert sorted(map(tuple, got)) == sorted(p for p in pairs(least, most) if p[1] == "n4"), text
    found = paths.within(links, nodes.filter("k < 3"), 1, 3)
    assert {r.source for r in found.select("source").distinct().collect()} <= {"n0", "n1", "n2"}


def test_budgeted_walk(spark):
    rng = random.Random(5)
    for budget in (6, 12, 40):
        edges = sorted({(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}", rng.choice("AB")) for _ in range(60)})
        nodes = {f"n{k}": (rng.choice(["Fact", "Session", "Note"]), rng.randrange(1, 5)) for k in range(14)}  # n14 isn't known
        seeds = {1: ["n0", "n3"], 2: ["n5"], 3: ["nowhere"]}
        want = []
        for q, ids in seeds.items():
            taken = [(i, 0, None) for i in ids]
            room = budget - sum(nodes[i][1] if i in nodes else 0 for i in ids)
            level = list(ids)
            for d in (1, 2):
                nxt = []
                for source in level:
                    for kind, target in sorted((k, t) for s, t, k in edges if s == source):
                        if target in {t[0] for t in taken} or target not in nodes or nodes[target][0] == "Session" or nodes[target][1] > room:
                            continue
                        room -= nodes[target][1]
                        taken.append((target, d, kind))
                        nxt.append(target)
                level = nxt
            want += [(q, n + 1, *t) for n, t in enumerate(taken)]
        got = paths.budgeted(
            spark.createDataFrame(edges, "source string, target string, type string"), spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id string, label string, cost int"),
            spark.createDataFrame([(q, i, n) for q, ids in seeds.items() for n, i in enumerate(ids)], "query_id int, id string, place int"), 2, budget, {"A": 0.9},
        ).collect()
        assert sorted((r.query_id, r.place, r.id, r.distance, r.via) for r in got) == sorted(want, key=lambda r: r[:2])
        assert {r.score for r in got if r.via == "A"} <= {0.9} and {r.score for r in got if r.via == "B"} <= {0.5}
