"""SimHash fingerprints and their near-duplicate groups by a self-join of binary tries.

Fingerprints within a budget of b bits agree wholly in one of b + 1 blocks of their bits. So the bits are
rotated b + 1 times, a block to the front each time, and each rotation of the distinct fingerprints is a binary
trie whose top levels, down to the end of that block, allow no differing bit: a fingerprint is sent b + 1 times,
whatever their number. A task gets a node of such a trie and joins it with itself from the block's end on, level by
level: a pair of nodes splits into its four pairs of children, adds up the bits in which the two prefixes differ,
and is dropped as soon as they exceed the budget. Pairs of small nodes compare their leaves. A block shared by more
than node_size fingerprints is cut deeper, and its nodes travel in the pairs that the budget allows. A node returns a
spanning forest of the links it finds, so that a dense cloud of near copies costs rows in proportion to its
fingerprints, and no connection is lost.

Defined results: null or empty texts and texts without words have fingerprint 0, which links like any
other; rows with a null id take part and count only where nothing else names the group; repeated rows
share a fingerprint; an empty table gives no rows; extra columns pass through with_fingerprint() whatever their
names, one named as its output is replaced. A very long text is fingerprinted alone, in memory in proportion to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.components import components
from weftgraph.llm.shared import pieces, written

SEED, SHINGLE, BUDGET = 42, 3, 3
#: Fingerprints that a task gets at a time, about, and at most in one piece (8 bytes each).
TASK_SIZE, NODE_SIZE = 8192, 1 << 17
#: Pairs of leaves below a pair of nodes that are compared at once.
SMALL = 64
#: Pairs of nodes that are split together; bounds a task's memory.
FRONT = 20_000

#: For each byte, its bits as eight counters of one byte.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: str | None, shingle: int, seed: int) -> list[int]:
    """Hashes of the runs of so many words, repeats included; of the whole sequence if it is shorter, none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(line, seed)] if words else []
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return [xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])]


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64 bits of each text: a bit is set if it is in over half of the shingle hashes, repeats included."""
    return voted([shingle_hashes(t, shingle, seed) for t in texts])


def voted(found: list[list[int]]) -> np.ndarray:
    """The majority of each bit in lists of hashes."""
    hashes, counts = [h for f in found for h in f], [len(f) for f in found]
    out = np.zeros(len(found), np.uint64)
    sizes = np.array(counts, np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    planes = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    # one-byte counters overflow beyond 255 rows, so each text is summed in blocks of that many
    ends = np.cumsum(sizes[some])
    starts = ends - sizes[some]
    blocks = (sizes[some] + 254) // 255
    first = np.cumsum(blocks) - blocks
    cuts = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    sums = np.empty((len(some), 64), np.int64)
    for plane in range(8):
        lanes = np.add.reduceat(SPREAD[planes[:, plane]], cuts).view(np.uint8).reshape(-1, 8)
        sums[:, plane * 8 : plane * 8 + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    out[some] = np.packbits(2 * sums > sizes[some][:, None], axis=1).view(">u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long, all columns kept (one named `out` is replaced)."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, 500):
                found = fingerprints(part.column(text).to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found)], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def _children(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where bit becomes 1 in each of the sorted runs values[lo:hi], whose higher bits agree."""
    top = values[lo] | np.uint64((1 << bit) - 1)
    border = (top | np.uint64(1 << bit)) & ~np.uint64((1 << bit) - 1)
    return np.clip(np.searchsorted(values, border), lo, hi)


def trie_join(a: np.ndarray, b: np.ndarray, budget: int, depth: int = 0, apart: int = 0, block: int = 0):
    """Yields arrays (i, j) with a[i] and b[j] within the budget; a and b sorted, their top depth bits `apart`.

    With a block the two are the same array, and only pairs that agree in its top block bits are looked for.
    """
    if not len(a) or not len(b):
        return
    if block:
        cuts = np.flatnonzero(np.diff(a >> np.uint64(64 - block))) + 1
        lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(a)]])
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        front = [(block, lo[k : k + FRONT], hi[k : k + FRONT], lo[k : k + FRONT], hi[k : k + FRONT], np.zeros(len(lo[k : k + FRONT]), np.int64)) for k in range(0, len(lo), FRONT)]
    else:
        front = [(depth, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), apart)))]
    while front:
        depth, alo, ahi, blo, bhi, apart = front.pop()
        small = ((ahi - alo) * (bhi - blo) <= SMALL) | (depth == 64)
        if small.any():
            x = [v[small] for v in (alo, ahi, blo, bhi)]
            wide = x[3] - x[2]
            pairs = (x[1] - x[0]) * wide
            of = np.repeat(np.arange(len(pairs)), pairs)
            k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i, j = x[0][of] + k // wide[of], x[2][of] + k % wide[of]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        alo, ahi, blo, bhi, apart = (v[~small] for v in (alo, ahi, blo, bhi, apart))
        bit = 63 - depth
        amid, bmid = _children(a, alo, ahi, bit), _children(b, blo, bhi, bit)
        sides = []
        for (p, q), (r, s), cost in (((alo, amid), (blo, bmid), 0), ((amid, ahi), (bmid, bhi), 0), ((alo, amid), (bmid, bhi), 1), ((amid, ahi), (blo, bmid), 1)):
            live = (p < q) & (r < s) & (apart + cost <= budget)
            sides.append((p[live], q[live], r[live], s[live], apart[live] + cost))
        joined = [np.concatenate(v) for v in zip(*sides, strict=True)]
        front += [(depth + 1, *(v[k : k + FRONT] for v in joined)) for k in range(0, len(joined[0]), FRONT)]


def forest(found, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (i, j); at most n - 1 of them are kept."""
    root, kept = np.arange(n), []
    for i, j in found:
        while True:
            p, q = root[i], root[j]
            some = p != q
            if not some.any():
                break
            i, j, high, low = i[some], j[some], np.maximum(p, q)[some], np.minimum(p, q)[some]
            _, first = np.unique(high, return_index=True)  # each tree hangs itself below a smaller one, by one link
            root[high[first]] = low[first]
            kept.append((i[first], j[first]))
            while not np.array_equal(up := root[root], root):
                root = up
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(k[side] for k in kept)]).astype(np.int64) for side in (0, 1))


def nodes(distinct: DataFrame, block: int, turns: int, node_size: int) -> tuple[DataFrame, int]:
    """(turn, depth, prefix, fps) rows of at most node_size fingerprints of each rotation; and a number of tasks for them."""
    depth = min(block, max(1, (distinct.count() // TASK_SIZE).bit_length()))
    tasks = turns << depth
    turned = [F.col("fp") if k == 0 else F.shiftleft("fp", k * block).bitwiseOR(F.shiftrightunsigned("fp", 64 - k * block)) for k in range(turns)]
    rest = distinct.select(F.posexplode(F.array(*turned)).alias("turn", "fp"))
    parts = []
    while True:
        placed = rest.withColumn("prefix", F.shiftrightunsigned("fp", 64 - depth)).withColumn("depth", F.lit(depth))
        counts = placed.groupBy("turn", "prefix").agg(F.count("*").alias("n"))
        crowded = written(counts.filter(F.col("n") > node_size).select(F.col("turn").alias("of"), F.col("prefix").alias("p")), "crowded")
        full = depth >= 60 or crowded.isEmpty()
        same = (F.col("turn") == F.col("of")) & (F.col("prefix") == F.col("p"))
        parts.append(placed if full else placed.join(crowded, same, "left_anti"))
        if full:
            break
        rest = written(placed.join(crowded, same, "left_semi").select("turn", "fp"), "rest")
        depth = min(60, depth + 4)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("turn", "depth", "prefix").agg(F.collect_list("fp").alias("fps")), tasks


def links(distinct: DataFrame, budget: int = BUDGET, node_size: int = NODE_SIZE) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp, each once): a spanning forest of all pairs within the budget."""
    block = 64 // (budget + 1)
    table, tasks = nodes(distinct, block, budget + 1, node_size)
    table = written(table, "nodes")
    deep = table.filter(F.col("depth") > block)
    names = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("turn", "depth", "prefix", "fps")]
    cell = lambda s: F.call_function("shiftrightunsigned", F.col(f"prefix_{s}"), (F.col(f"depth_{s}") - block).cast("int"))
    cut = lambda s: F.call_function("shiftrightunsigned", F.col(f"prefix_{s}"), (F.col(f"depth_{s}") - F.col("low")).cast("int"))
    left, right = deep.select(*names("a")).withColumn("cell_a", cell("a")), deep.select(*names("b")).withColumn("cell_b", cell("b"))
    pairs = left.join(right, (F.col("turn_a") == F.col("turn_b")) & (F.col("cell_a") == F.col("cell_b")) & ((F.col("prefix_a") < F.col("prefix_b")) | ((F.col("prefix_a") == F.col("prefix_b")) & (F.col("depth_a") < F.col("depth_b")))))
    pairs = pairs.withColumn("low", F.least("depth_a", "depth_b")).withColumn("apart", F.bit_count(cut("a").bitwiseXOR(cut("b")))).filter(F.col("apart") <= budget)
    own = table.select(F.col("turn").alias("turn_a"), F.col("prefix").alias("prefix_a"), F.lit(-1).cast("long").alias("prefix_b"), F.col("fps").alias("fps_a"), F.lit(None).cast("array<bigint>").alias("fps_b"), F.greatest("depth", F.lit(block)).alias("low"), F.lit(0).alias("apart"))
    rows = own.unionByName(pairs.select("turn_a", "prefix_a", "prefix_b", "fps_a", "fps_b", "low", "apart"))

    def run(batches):
        for batch in batches:
            got = {c: batch.column(c) for c in ("turn_a", "fps_a", "fps_b", "low", "apart")}
            for k in range(batch.num_rows):
                a, low = np.sort(got["fps_a"][k].values.to_numpy(zero_copy_only=False).view(np.uint64)), got["low"][k].as_py()
                if got["fps_b"][k].is_valid:
                    b = np.sort(got["fps_b"][k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    found = ((i, j + len(a)) for i, j in trie_join(a, b, budget, low, got["apart"][k].as_py()))
                    both = np.concatenate([a, b])
                else:
                    found, both = ((i[i < j], j[i < j]) for i, j in trie_join(a, a, budget, block=low)), a
                i, j = forest(found, len(both))
                shift = got["turn_a"][k].as_py() * block
                plain = ((both >> np.uint64(shift)) | (both << np.uint64(64 - shift)) if shift else both).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(plain[i]), pa.array(plain[j])], names=["a", "b"])

    return rows.repartition(max(8, min(4096, tasks)), F.xxhash64("turn_a", "prefix_a", "prefix_b")).mapInArrow(run, "a long, b long")


def groups(marked: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint", budget: int = BUDGET, node_size: int = NODE_SIZE) -> DataFrame:
    """(fp, root, component_id): for each distinct fingerprint its group and the smallest id in it.

    marked should be a written table: it is read more than once.
    """
    distinct = written(marked.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(doc_id).alias("least")), "distinct")
    joined = components(links(distinct.select("fp"), budget, node_size))
    joined = written(joined, "components")
    rooted = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    return written(rooted.join(written(least, "least"), F.col("root") == F.col("r")).select("fp", "root", "component_id"), "groups")
