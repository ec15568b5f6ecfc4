"""Shards of nearly equal size from a minimax contiguous partition.

Rows with equal texts form a group that stays whole. Groups are ordered by a digest of the text, and the
smallest capacity is searched with which a greedy walk over that order needs no more than the given
shards. At that capacity each cut is placed next to its equal share of the whole, as far as the walks from both
ends allow, so that no shard is left nearly empty. Groups above the mean size of a shard come first in the order and
get shards of their own, so that they don't set the capacity of all others. As the order follows from the
text, so does a row's shard, given the cut keys: no join brings groups and rows together.

The walk needs the sizes of single groups only near its cuts. The key space is cut into blocks whose totals
come to the driver (RANGES of them, then a few times that at most). They bound the capacity and the
places of all cuts; blocks in which a cut may fall are cut finer, until each of them is one group. Then the
search is exact.

Defined results: a null text is the empty text, of size 8; repeated rows stay together, and rows that agree in id,
text and size take slots in any order; null ids are allowed, even for all rows; an empty table gives no rows; with
fewer groups than shards some shards stay empty; groups of equal size follow their digests. Columns other than id
and text are not read, whatever their names. Of a very long text only size and digests are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.llm.shared import written

#: Blocks of the key space whose totals are on the driver at once, about.
RANGES = 1 << 14
KEY_BITS = 63


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2): k1 is a non-negative 63-bit digest, k2 another one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(t, F.lit(1)), 1).alias("k1"),
        F.xxhash64(F.lit(2), t).alias("k2"),
    )


@dataclass(frozen=True)
class Block:
    """Neighbouring groups from `key` on: their size, and how many they are."""

    key: tuple[int, int]
    size: int
    groups: int
    bits: int


class Walk:
    """Greedy walks over blocks, within bounds where a cut falls into a block of several groups."""

    def __init__(self, blocks: list[Block], shards: int):
        self.blocks, self.shards = blocks, shards
        self.upto = [0, *accumulate(b.size for b in blocks)]

    def _floor(self, x: int) -> int:
        return self.upto[bisect_right(self.upto, x) - 1]

    def low(self, capacity: int) -> list[int]:
        """Places that the cuts reach at least: whole blocks are taken."""
        at, out = 0, []
        for _ in range(self.shards):
            at = self._floor(at + capacity)
            out.append(at)
        return out

    def high(self, capacity: int) -> list[int]:
        """Places that the cuts reach at most: a block of several groups may end anywhere."""
        at, out = 0, []
        for _ in range(self.shards):
            x = min(at + capacity, self.upto[-1])
            k = min(bisect_right(self.upto, x) - 1, len(self.blocks) - 1)
            at = x if self.blocks[k].groups > 1 else self._floor(x)
            out.append(at)
        return out

    def smallest(self, reach) -> int:
        """The smallest capacity with which the walk gets to the end."""
        low, high = -(-self.upto[-1] // self.shards), self.upto[-1]
        while low < high:
            mid = (low + high) // 2
            if reach(mid)[-1] >= self.upto[-1]:
                high = mid
            else:
                low = mid + 1
        return low

    def open_blocks(self) -> list[Block]:
        """Blocks of several groups in which a cut may fall at the capacities that are still possible."""
        least, most = self.low(self.smallest(self.high)), self.high(self.smallest(self.low))
        found: dict[int, Block] = {}
        for share in self._shares():
            k = min(bisect_right(self.upto, share) - 1, len(self.blocks) - 1)
            if self.blocks[k].groups > 1:
                found[k] = self.blocks[k]
        for a, b in zip(least, most, strict=True):
            if a < b:
                for k in range(max(0, bisect_right(self.upto, a) - 1), min(bisect_left(self.upto, b), len(self.blocks))):
                    if self.blocks[k].groups > 1:
                        found[k] = self.blocks[k]
        return list(found.values())

    def _shares(self) -> list[int]:
        """Where the cuts would be if groups could be cut."""
        return [self.upto[-1] * k // self.shards for k in range(1, self.shards)]

    def cuts(self) -> list[tuple[int, int]]:
        """Keys at which a new shard begins; only without open blocks.

        A cut may lie between the place that the walk from the end needs and the one that the walk from the start
        reaches; there it is put as near to its share as can be, the lower one of two."""
        capacity = self.smallest(self.low)
        reached = self.low(capacity)
        needed, at = [], self.upto[-1]
        for _ in range(self.shards - 1):
            at = self.upto[bisect_left(self.upto, at - capacity)]
            needed.append(at)
        places, before = set(), 0
        for share, least, most in zip(self._shares(), needed[::-1], reached, strict=False):
            most = self._floor(min(most, before + capacity))
            k = bisect_right(self.upto, share) - 1
            near = self.upto[k] if k + 1 == len(self.upto) or share - self.upto[k] <= self.upto[k + 1] - share else self.upto[k + 1]
            before = min(max(near, least, before), most)
            places.add(before)
        return [self.blocks[bisect_left(self.upto, x)].key for x in sorted(places) if 0 < x < self.upto[-1]]


def _totals(groups: DataFrame, bits: int) -> list[Block]:
    if bits >= KEY_BITS:
        rows = groups.groupBy("k1", "k2").agg(F.sum("size").alias("size"), F.lit(1).alias("n"), F.lit(0).alias("b")).orderBy("k1", "k2").collect()
        return [Block((r.k1, r.k2), r.size, 1, KEY_BITS) for r in rows]
    b = F.shiftright("k1", KEY_BITS - bits)
    rows = groups.groupBy(b.alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("b").collect()
    return [Block((r.b << (KEY_BITS - bits), -(1 << 63)), r.size, r.n, bits) for r in rows]


def plan(groups: DataFrame, shards: int, ranges: int = RANGES) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(keys of the groups with shards of their own, keys at which the other shards begin).

    groups: (k1, k2, size), one row each, a written table.
    """
    giants: list[tuple[int, int]] = []
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = groups.filter(F.col("size") * shards > total).orderBy(F.desc("size"), "k1", "k2").limit(shards).collect()  # fewer than `shards` can be
    left = total
    for g in large:
        if g.size * (shards - len(giants)) > left and len(giants) < shards - 1:
            giants.append((g.k1, g.k2))
            left -= g.size
    rest = groups.filter(~_is_one_of(giants)) if giants else groups
    bits = max(1, (ranges - 1).bit_length())
    blocks = _totals(rest, bits)
    while blocks:
        walk = Walk(blocks, shards - len(giants))
        opened = walk.open_blocks()
        if not opened:
            return giants, walk.cuts()
        finer = bits + max(1, (4 * ranges // len(opened)).bit_length() - 1)
        if sum(b.groups for b in opened) <= 8 * ranges or finer > KEY_BITS:
            finer = KEY_BITS
        keys = groups.sparkSession.createDataFrame([(b.key[0] >> (KEY_BITS - bits),) for b in opened], "open long")
        inside = rest.join(keys, F.shiftright("k1", KEY_BITS - bits) == F.col("open"), "left_semi")
        gone = {b.key for b in opened}
        blocks = sorted([b for b in blocks if b.key not in gone] + _totals(inside, finer), key=lambda b: b.key)
        bits = finer
    return giants, []


def _is_one_of(keys: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for k1, k2 in keys:
        out = out | ((F.col("k1") == k1) & (F.col("k2") == k2))
    return out


def shard_of(giants: list[tuple[int, int]], cuts: list[tuple[int, int]]) -> Column:
    """The shard as an expression of the keys: as many comparisons as shards."""
    out = F.lit(len(giants))
    for k1, k2 in cuts:
        out = out + ((F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))).cast("int")
    for n, key in enumerate(giants):
        out = F.when(_is_one_of([key]), F.lit(n)).otherwise(out)
    return out.cast("int")


def with_slots(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds slot: numbers from 0 without gaps in each shard. rows should be a written table, numbered by n.

    A shard is dealt into as many buckets as the root of its rows; rows are numbered inside a bucket by id,
    digest and size, and buckets by their sums. Rows without an id are dealt by their number, rather than together.
    """
    most = rows.groupBy("shard").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    dealt = rows.withColumn("_sub", F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("row"), F.col("n"))), F.lit(3)), F.lit(max(1, isqrt(most)))))
    counts = dealt.groupBy(F.col("shard").alias("_shard"), F.col("_sub").alias("_bucket")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("_shard").orderBy("_bucket")) - F.col("_n"))
    inside = dealt.withColumn("_in", F.row_number().over(W.partitionBy("shard", "_sub").orderBy(doc_id, "text_crc32", "size", "n")) - 1)
    at = inside.join(before, (F.col("shard") == F.col("_shard")) & (F.col("_sub") == F.col("_bucket")))
    return at.withColumn("slot", F.col("_before") + F.col("_in")).drop("_shard", "_bucket", "_sub", "_n", "_before", "_in", "n")


def sharded(docs: DataFrame, shards: int, ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of all documents."""
    rows = written(keyed(docs).withColumn("n", F.monotonically_increasing_id()), "keyed")
    groups = written(rows.groupBy("k1", "k2").agg(F.sum("size").alias("size")), "groups")
    giants, cuts = plan(groups, shards, ranges)
    return with_slots(rows.withColumn("shard", shard_of(giants, cuts)).drop("k1", "k2"))
