"""The capacity against the exact search over all groups, and the rows against their laws."""

import random
import zlib
from bisect import bisect_right
from itertools import accumulate

import pytest

from weftgraph.llm import sharding
from weftgraph.llm.shared import written


def exact(sizes, shards):
    """Smallest capacity and cuts by trying all capacities that can matter, one after another."""
    upto = [0, *accumulate(sizes)]
    low, high = max(sizes), sum(sizes)
    while True:
        capacity = (low + high) // 2 if low < high else low
        at, cuts = 0, []
        while at < len(sizes):
            at = bisect_right(upto, upto[at] + capacity) - 1
            cuts.append(at)
        if low == high:
            return capacity, cuts
        low, high = (low, capacity) if len(cuts) <= shards else (capacity + 1, high)


@pytest.mark.parametrize("ranges,n,shards", [(4, 300, 7), (16, 500, 24), (2, 40, 3), (4, 3, 5), (8, 2000, 5)])
def test_cuts_are_exact(spark, ranges, n, shards):
    rng = random.Random(n)
    keys = sorted((rng.randrange(1 << 63) if rng.random() < 0.8 else 5 << 58, rng.randrange(-(1 << 63), 1 << 63)) for _ in range(n))
    sizes = [rng.randrange(8, 400) for _ in keys]
    if n > 100:
        sizes[3] = sum(sizes)  # a giant
    table = written(spark.createDataFrame([(*k, s) for k, s in zip(keys, sizes)], "k1 long, k2 long, size long"), "t")
    giants, cuts = sharding.plan(table, shards, ranges)
    rest = [(k, s) for k, s in zip(keys, sizes) if k not in giants]
    assert len(giants) == (1 if n > 100 else len(giants))
    if not rest:  # each group has a shard of its own
        assert cuts == [] and len(giants) == n
        return
    m = shards - len(giants)
    capacity, _ = exact([s for _, s in rest], m)
    starts = [0, *[next(n for n, (k, _) in enumerate(rest) if k >= c) for c in cuts], len(rest)]
    loads = [sum(s for _, s in rest[x:y]) for x, y in zip(starts, starts[1:])]
    assert max(loads) == capacity if len(rest) < m else max(loads) <= capacity and len(loads) <= m
    # each cut is as near to its share as the walks from both ends at that capacity allow
    upto = [0, *accumulate(s for _, s in rest)]
    left, right, x, y = [], [], 0, upto[-1]
    for _ in range(m - 1):
        x = max(u for u in upto if u <= x + capacity)
        y = min(u for u in upto if u >= y - capacity)
        left.append(x), right.append(y)
    before, want = 0, set()
    for k, (least, most) in enumerate(zip(right[::-1], left), 1):
        most = max(u for u in upto if u <= min(most, before + capacity))
        near = min(upto, key=lambda u: (abs(u - upto[-1] * k // m), u))
        before = min(max(near, least, before), most)
        want.add(before)
    assert [upto[n] for n in starts[1:-1]] == sorted(w for w in want if 0 < w < upto[-1])
    if n > 100:
        assert min(loads) > sum(loads) / m - 2 * 400


def test_query_on_whole_table(spark):
    import pandas as pd

    from weftgraph.llm.queries_sharding import op7_minimax_shards

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    out = op7_minimax_shards(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(zip(out.doc_id, out["size"], out.text_crc32)) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text))
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() / loads.min() < 1.3 and set(out.law) == {"bytes"}
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)


def test_rows(spark):
    rows = [(i, f"text {i % 50} " + "é" * (i % 17)) for i in range(400)] + [(None, None), (7, ""), (7, ""), (8, "big " * 9000)] + [(1000 + i, "copy " * 40) for i in range(200)]
    out = sharding.sharded(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string"), 6).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    for k in range(6):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert all(len({r.shard for r in out if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in out})
    loads = sorted(sum(r.size for r in out if r.shard == k) for k in range(6))
    assert loads[-1] == max(9000 * 4 + 8, 200 * 208) and loads[0] > 0.5 * loads[3]
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string"), 6).count() == 0
