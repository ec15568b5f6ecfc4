"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides. The trie join of SimHash fingerprints (over the same shingles) gives the closest
copies, within three bits. Texts of similarity 0.8 differ in about ten of 64 bits, more than a trie join can
allow, so the others share one of BANDS hashes, each of ROWS minima over the shingles, which a
pair of similarity 0.8 misses with a chance of (1 - 0.8^5)^20, or 0.0004. All candidates are compared by their whole
shingle sets. First each member of a bucket is compared with the smallest one, then, where that leaves a bucket
in several groups, with the one that has the fewest shingles of its own (the text that copies were made from has none),
then, where that too leaves several groups, those outside its largest group with members of other groups, but for pairs
that three exact bounds rule out: the sizes of the sets; the shingles that no other such member has, which no pair can
share (a text with more than a fifth of these is out before it meets another); and the sum of these in both and of 1,024
parity bits of their other shingles, of which a pair differs in no more than in shingles. So every pair of a bucket is
compared, ruled out or connected already, and a dense cloud of near copies costs rows in proportion to it, while of a
cloud of texts that are less alike hardly a pair becomes a row.

Defined results: null or empty texts and texts without words have the empty set, which equals itself alone; a text
of fewer than five words is one shingle; equal sets are one node; null and repeated ids don't matter, as rows go by
`_row`; an empty table gives no groups. A very long text is handled alone, in memory in proportion to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import simhash
from weftgraph.llm.components import components
from weftgraph.llm.shared import pieces, written

SHINGLE, SEED = 5, 42
BANDS, ROWS = 20, 5
_RANDOM = np.random.default_rng(SEED)
TIMES, FLIPS = (_RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)), _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
#: 64-bit words of the parity bits of a set, and the shift of a hash that leaves a number of one of them.
PARITY_WORDS, PARITY_SHIFT = 16, 54
#: Shingles that are hashed for all minima at once; bounds memory.
BLOCK = 4096


def grams(text: str | None) -> np.ndarray:
    """The sorted set of shingle hashes."""
    return np.unique(np.array(simhash.shingle_hashes(text, SHINGLE, SEED), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The band hashes of a shingle set."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[None, at : at + BLOCK] ^ FLIPS[:, None]) * TIMES[:, None]).min(axis=1))
    least = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        out = (out ^ least[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def marked(rows: DataFrame) -> DataFrame:
    """(_row, doc_id) with the hash of the shingle set, key, its size, its bands, and the fingerprint."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in pieces(batch, "text", 500):
                hashes = [simhash.shingle_hashes(t, SHINGLE, SEED) for t in part.column("text").to_pylist()]
                sets = [np.unique(np.array(h, np.uint64)) for h in hashes]
                keys = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                flat = np.concatenate([bands(s) for s in sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(flat))
                columns = [part.column("_row"), part.column("doc_id"), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), lists, pa.array(simhash.voted(hashes).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "key", "size", "bands", "fingerprint"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_row", "doc_id"))
    return rows.select("_row", "doc_id", "text").mapInArrow(run, f"{kept}, key bigint, size bigint, bands array<bigint>, fingerprint bigint")


def parities(found: np.ndarray) -> np.ndarray:
    """1,024 bits: for each beginning of a hash whether an odd number of the shingle hashes has it; its number counts bits from the
    lowest of the first word."""
    odd = np.bincount((found >> np.uint64(PARITY_SHIFT)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    """(key, shingle set as bytes, p0, ..: its parity bits) of (key, text)."""
    names = [f"p{k}" for k in range(PARITY_WORDS)]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 500):
                found = [grams(t) for t in part.column("text").to_pylist()]
                bits = np.stack([parities(g) for g in found], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([g.tobytes() for g in found], pa.binary()), *map(pa.array, bits)], names=["key", "grams", *names])

    return texts.select("key", "text").mapInArrow(run, f"key bigint, grams binary, {', '.join(f'{n} bigint' for n in names)}")


def _shingles(sets: DataFrame) -> DataFrame:
    """(key, h): a row for each shingle of each set."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "grams", 500):
                found = [np.frombuffer(g.as_buffer(), np.int64) if g.as_buffer() is not None else np.zeros(0, np.int64) for g in part.column("grams")]
                keys = np.repeat(part.column("key").to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(found))], names=["key", "h"])

    return sets.select("key", "grams").mapInArrow(run, "key bigint, h bigint")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c) for c in ("grams_a", "grams_b"))
            good = [alike(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = lambda s: sets.select(F.col("key").alias(s), F.col("grams").alias(f"grams_{s}")).hint("merge")
    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a bigint, b bigint")


def _close(distinct: DataFrame) -> DataFrame:
    """(a, b) of keys whose fingerprints are equal or linked by the trie join, each linked to one key of a fingerprint."""
    held = distinct.select("key", F.col("fingerprint").alias("fp"))
    first = written(held.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    same = held.join(first.hint("merge"), "fp").filter("key <> least").select(F.col("key").alias("x"), F.col("least").alias("y"))
    of = lambda s: first.select(F.col("fp").alias(s), F.col("least").alias(f"key_{s}")).hint("merge")
    near = simhash.links(first.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("key_a").alias("x"), F.col("key_b").alias("y"))
    return same.union(near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


PARITIES = [f"p{k}" for k in range(PARITY_WORDS)]


def _able(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """The members that may be alike others in their buckets, with `most`, the shingles that they can share, and the parity bits of those.

    A shingle that only one of all these members has is shared by no pair of a bucket.
    """
    asked = written(mixed.select(F.col("key").alias("k"), "size").distinct(), "asked").hint("merge")
    own = sets.join(asked, F.col("key") == F.col("k")).select("key", "size", "grams", *PARITIES)
    lone = _shingles(own).groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("of")).filter("n = 1")
    lone = lone.withColumn("number", F.shiftrightunsigned("h", PARITY_SHIFT).cast("int")).withColumn("bit", F.expr("shiftleft(1L, number & 63)"))
    theirs = [F.bit_xor(F.when(F.shiftright("number", 6) == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"lone_{p}") for k, p in enumerate(PARITIES)]
    lone = written(lone.groupBy("of").agg(F.count("*").alias("lone"), *theirs), "lone").hint("merge")
    able = own.join(lone, F.col("key") == F.col("of"), "left").withColumn("most", F.col("size") - F.coalesce("lone", F.lit(0)))
    shared = [F.col(p).bitwiseXOR(F.coalesce(f"lone_{p}", F.lit(0).cast("long"))).alias(p) for p in PARITIES]
    able = able.filter(F.col("most") * 5 >= F.col("size") * 4).select(F.col("key").alias("k"), "most", *shared)
    return mixed.join(written(able, "able").hint("merge"), F.col("key") == F.col("k")).select(*mixed.columns, "most", *PARITIES)


def _mixed(placed: DataFrame) -> DataFrame:
    """The members of the buckets with several roots, with the most frequent root as main."""
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    main = written(main.select(F.col("bucket").alias("mixed"), "main"), "main").hint("merge")
    return placed.join(main, F.col("bucket") == F.col("mixed")).select(*placed.columns, "main")


def _pairs(some: DataFrame, live: DataFrame) -> DataFrame:
    """(a, b), a > b, of some members with others of their buckets that have another root, unless a bound rules them out."""
    some = some.select("bucket", *[F.col(c).alias(f"{c}_x") for c in ("key", "size", "root", "most", *PARITIES)])
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_x"))) for p in PARITIES), F.lit(0))
    both = F.col("size") + F.col("size_x")
    apart = both - F.col("most") - F.col("most_x") + apart
    fits = (some["bucket"] == live["bucket"]) & (F.col("root") != F.col("root_x")) & (F.least("size", "size_x") * 5 >= F.greatest("size", "size_x") * 4)
    fits = fits & (F.least("most", "most_x") * 9 >= both * 4) & (apart * 9 <= both)
    return some.join(live.hint("merge"), fits).select(F.greatest("key_x", "key").alias("a"), F.least("key_x", "key").alias("b")).distinct()


def _moved(live: DataFrame, links: DataFrame) -> DataFrame:
    """live without main, with the roots that the links lead to."""
    own = written(live.select(F.col("key").alias("k"), F.col("root").alias("r")).distinct(), "own")
    of = lambda s: own.select(F.col("k").alias(s), F.col("r").alias(f"root_{s}")).hint("merge")
    ends = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    new = written(components(ends), "moved").select("node", F.col("root").alias("new")).hint("merge")
    return live.drop("main").join(new, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("new", "root")).drop("node", "new")


def groups(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the keys that are alike others; marks is a written table of marked(rows)."""
    distinct = marks.groupBy("key").agg(F.min("_row").alias("_of"), *[F.any_value(c).alias(c) for c in ("size", "bands", "fingerprint")])
    distinct = written(distinct, "distinct")
    held = distinct.select("key", "size", F.explode("bands").alias("band"))
    least = held.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("band").alias("bucket"), "least")
    least = written(least, "least").hint("merge")
    members = written(held.join(least, F.col("band") == F.col("bucket")).select("bucket", "least", "key", "size"), "members")
    stars = members.filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    stars = written(stars.union(_close(distinct)).distinct(), "stars")
    asked = members.select(F.col("key").alias("k")).union(stars.select("a")).union(stars.select("b")).distinct()
    needed = written(asked.join(distinct.select("key", "_of").hint("merge"), F.col("k") == F.col("key")).select("key", "_of"), "needed")
    sets = written(_sets(rows.select("_row", "text").join(needed.hint("merge"), F.col("_row") == F.col("_of"))), "sets")
    found = written(_links(stars, sets), "links")
    roots = written(components(found), "roots").hint("merge")
    placed = members.join(roots, F.col("key") == F.col("node"), "left").select("bucket", "key", "size", F.coalesce("root", "key").alias("root"))
    placed = written(placed, "placed")
    live = written(_able(written(_mixed(placed), "mixed"), sets), "live")
    centre = live.groupBy("bucket").agg(F.min(F.struct(F.col("size") - F.col("most"), "key"))["key"].alias("centre")).withColumnRenamed("bucket", "in")
    centre = live.join(written(centre, "centre").hint("merge"), (F.col("bucket") == F.col("in")) & (F.col("key") == F.col("centre"))).select(live.columns)
    near = written(_pairs(centre, live).join(stars.hint("merge"), ["a", "b"], "left_anti"), "near")
    second = written(_links(near, sets), "second")
    live = written(_mixed(written(_moved(live, second), "moved")), "live")
    pairs = _pairs(live.filter("root <> main"), live).join(stars.hint("merge"), ["a", "b"], "left_anti")
    pairs = written(pairs.join(near.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    return components(found.unionByName(second).unionByName(written(_links(pairs, sets), "more")))
