"""Against a brute-force version over all pairs."""

import re

import numpy as np
import pytest
import xxhash

from weftgraph.llm import simhash
from weftgraph.llm.components import components
from weftgraph.llm.shared import written


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i in range(len(fps)):
        least[top(i)] = min(x for x in (least.get(top(i)), ids[i]) if x is not None) if (least.get(top(i)), ids[i]) != (None, None) else None
    return [least[top(i)] for i in range(len(fps))]


TEXTS = [None, "", " \t\n", "one", "One two", "a b c", "a  b\tc", "a b c d", "É é É", "x " * 700, "x y " * 300, "lorem ipsum " * 5 + "é"]


def test_fingerprints():
    got = simhash.fingerprints(TEXTS)
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("size", [4, 64])
def test_groups_of_crowded_fingerprints(spark, size):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = [int(b) for b in base] + [0, 0, 1, 2**64 - 1]
    for _ in range(150):
        f = fps[int(rng.integers(len(fps)))]
        for bit in rng.integers(0, 64, int(rng.integers(0, 6))):
            f ^= 1 << int(bit)
        fps.append(f)
    ids = [int(x) for x in rng.permutation(len(fps))]
    ids[5] = None
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    rows = written(spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fingerprint long"), "t")
    found = {r.fp: r.component_id for r in simhash.groups(rows, node_size=size).collect()}
    assert [found[f] for f in signed] == brute_groups(ids, fps)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fingerprint string")
    marked = written(simhash.with_fingerprint(docs), "t")
    assert simhash.groups(marked).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
