"""Registered queries that SQL can't express, against plain versions over whole tables."""

import hashlib
import random
import re
from collections import defaultdict

import pandas as pd
import pytest

from weftgraph.operators import textops as T
from weftgraph.plans.registry import CATALOG

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet").to_dict("records")


def in_order(ids, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[b].add(a)
    kept = {}
    for i in sorted(ids):
        kept[i] = not any(kept[a] for a in near[i])
    return kept


@pytest.mark.parametrize("walked", [0, 5, 10**6])
def test_first_come_on_components(spark, walked):
    rng = random.Random(walked)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(35)}
    ids = spark.createDataFrame([(i,) for i in range(45)], "id long")
    got = T.first_come(ids, spark.createDataFrame(sorted(pairs), "a long, b long"), walked)
    assert {r.id: r.kept for r in got.collect()} == in_order(range(45), pairs)


def test_first_come_on_a_long_chain(spark):
    ids = spark.createDataFrame([(i,) for i in range(500)], "id long")
    pairs = [(i, i + 1) for i in range(499)]
    got = T.first_come(ids, spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.kept for r in got.collect()} == {i: i % 2 == 0 for i in range(500)}


def fingerprint(text):
    low = re.sub(r"\s+", " ", (text or "").strip().lower())
    words = [w for w in re.split(r"\s+", low) if w]
    parts = words if len(words) >= 3 else [c for c in low]
    n = max(1, len(parts) - 2)
    hashes = [int(hashlib.md5(" ".join(parts[i : i + 3]).encode()).hexdigest(), 16) & (2**64 - 1) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_dedup_simhash(spark):
    first = {}
    docs = sorted((r["doc_id"], fingerprint(r["text"])) for r in read("documents"))
    for i, f in docs:
        first.setdefault(f, i)
    reps = sorted((i, f) for f, i in first.items())
    pairs = [(a, b) for k, (a, f) in enumerate(reps) for b, g in reps[k + 1 :] if (f ^ g).bit_count() <= 6]
    kept = in_order([i for i, _ in reps], pairs)
    got = {r.id: r.kept for r in CATALOG["dedup_simhash"].run(spark, SF).collect()}
    assert got == {i: kept.get(i, False) for i, _ in docs} and not all(got.values())


def test_star_merge(spark):
    rows = sorted((str(r["s_suppkey"]), str(r["s_nationkey"]), r["s_name"].strip().lower()) for r in read("supplier"))
    lead, leaders = {}, defaultdict(list)
    for i, label, name in rows:
        words = set(name.split())
        alike = [j for j, other in leaders[label] if other == words or len(other & words) / len(other | words) >= 0.85]
        lead[i] = alike[0] if alike else i
        if not alike:
            leaders[label].append((i, words))
    assert {r.id: r.survivor for r in CATALOG["star_merge"].run(spark, SF).collect()} == lead


def test_budget_selection(spark):
    want, groups = set(), defaultdict(list)
    for r in read("events"):
        groups[r["user_id"]].append((-r["value"], r["event_id"], r["event_id"] % 50 + 1))
    for user, some in groups.items():
        left, place = 120, 0
        for _, i, cost in sorted(some):
            if cost <= left:
                left, place = left - cost, place + 1
                want.add((user, i, place))
    assert {tuple(r) for r in CATALOG["budget_selection"].run(spark, SF).select("user_id", "id", "place").collect()} == want


def test_pagerank_directed(spark):
    keys = {t: read(t) for t in ("customer", "supplier", "nation", "region")}
    edges = [(f"C:{r['c_custkey']}", f"N:{r['c_nationkey']}") for r in keys["customer"]] + [(f"S:{r['s_suppkey']}", f"N:{r['s_nationkey']}") for r in keys["supplier"]]
    edges += [(f"N:{r['n_nationkey']}", f"R:{r['n_regionkey']}") for r in keys["nation"]]
    nodes = [f"C:{r['c_custkey']}" for r in keys["customer"]] + [f"S:{r['s_suppkey']}" for r in keys["supplier"]] + [f"N:{r['n_nationkey']}" for r in keys["nation"]] + [f"R:{r['r_regionkey']}" for r in keys["region"]]
    out = defaultdict(list)
    for s, t in edges:
        out[s].append(t)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(30):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for s, targets in out.items():
            for t in targets:
                new[t] += 0.85 * rank[s] / len(targets)
        change, rank = sum(abs(new[n] - rank[n]) for n in nodes), new
        if change < 1e-6:
            break
    got = {r.id: r["rank"] for r in CATALOG["pagerank_directed"].run(spark, SF).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 2e-6 for n in rank)
