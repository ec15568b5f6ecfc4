"""Edited copies against a brute-force version over all pairs of shingle sets."""

import random

import numpy as np

import corpus_pipeline
from weftgraph.llm import nearcopies

TABLE = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {" ".join(w)}


def survivors(rows):
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return sorted(min(d for k, (d, _) in enumerate(rows) if top(k) == t) for t in {top(k) for k in range(len(rows))})


def edited(rng, words, step):
    out = list(words)
    for k in range(rng.randrange(step), len(out), step):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def test_edited_copies_go(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t", "one two", "One  two", "one two three"]
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 700))]
        texts += [" ".join(words), *(" ".join(edited(rng, words, step)) for step in (200, 100, 60, 45, 30))]
    # a dense cloud, and a chain whose ends are not alike
    cloud = [f"c{k}" for k in range(300)]
    texts += [" ".join(edited(rng, cloud, 130)) for _ in range(60)]
    # a cloud of texts that are less alike, and some of them nearly twice
    loose = [f"l{k}" for k in range(200)]
    for _ in range(40):
        words = edited(rng, loose, 12)
        texts += [" ".join(words), " ".join(edited(rng, words, 60))][: rng.randrange(1, 3)]
    chain = [f"d{k}" for k in range(400)]
    texts += [" ".join(chain[k : k + 300]) for k in range(0, 100, 10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, TABLE).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == survivors(rows)


def test_bounds_rule_out_no_pair():
    rng = np.random.default_rng(7)
    for _ in range(300):
        base = rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 2**64, int(rng.integers(0, 8)), dtype=np.uint64)])) for _ in range(2))
        if nearcopies.alike(a, b):
            apart = int(np.bitwise_count(nearcopies.parities(a).view(np.uint64) ^ nearcopies.parities(b).view(np.uint64)).sum())
            assert 9 * apart <= len(a) + len(b) and apart <= len(np.setxor1d(a, b))


def test_a_cloud_of_edited_copies_makes_few_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    texts = [" ".join(base)]
    for _ in range(160):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 5)):
            words[k] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, TABLE).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made, write = {}, nearcopies.written

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(nearcopies, "written", counted)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == survivors(rows)
    assert made["pairs"] <= len(rows)
