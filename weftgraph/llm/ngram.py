"""Interpolated modified Kneser-Ney n-gram model in memory-mapped sorted hash arrays.

Counting: tasks turn their texts into events (a word and the words before it, the first after a start mark,
an end mark last), sort and sum them, and send sorted blobs by ranges of the context's hash. The task of a
range merges its blobs and writes a shard: the n-gram hashes in order with their counts, and the context
hashes with total and number of continuations seen once, twice, more often. Each distinct n-gram then counts
once for the n-gram without its first word, which is how the next lower order is counted, down to words.
The word shards also keep plain counts. Discounts come from the counts of counts of each order.

Scoring: workers map the shards and look up a batch's distinct n-grams by binary search.

A model lies in the shared folder, so its size on disk is that of its n-grams (9 bytes each, 12 a
context, more for counts of 255 and up), while a task needs memory for one shard at most.

Defined results: null and empty texts consist of the end mark; an empty training set gives the uniform
distribution over the unknown word; repeated rows count as often as they come; equal texts get equal scores; an
empty table gives no rows; extra columns pass through, one named as an output is replaced. A very long text is
scored alone, in memory in proportion to it.
"""

from __future__ import annotations

import json
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.shared import get, local_path, pieces, put, shared_folder, strings, written

START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text for each shard, about.
SHARD_BYTES = 24 << 20
#: Events that a counting task sorts together; bounds its memory.
SORTED = 3_000_000
#: Texts of a step of scoring or counting.
TEXTS = 1000
BLOB = "level int, shard int, data binary"


def fold(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of its beginning and its last word."""
    with np.errstate(over="ignore"):
        h = (h ^ (t + np.uint64(0x9E3779B97F4A7C15) + (h << np.uint64(6)) + (h >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, ends included; bounds of the texts)."""
    from xxhash import xxh64_intdigest

    low = pc.ascii_lower(texts.fill_null(""))
    for space in "\t\n\x0b\x0c\r":
        low = pc.replace_substring(low, space, " ")
    parts = pc.split_pattern(low, " ")
    flat = parts.flatten()
    bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    some = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(some)])[bounds]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    table = np.array([xxh64_intdigest(w, 0) for w in strings(coded.dictionary)], np.uint64)
    words = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)
    return np.insert(words, kept[1:], END), kept + np.arange(len(kept))


def contexts(words: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For m = 1 .. order - 1 the hash of the m tokens before each token; 0 where the text has not so many,
    the start mark being one."""
    starts = bounds[:-1]
    out = []
    place = np.arange(len(words)) - np.repeat(starts, np.diff(bounds))
    for m in range(1, order):
        h = np.zeros(len(words), np.uint64)
        for back in range(m, 0, -1):
            at = np.arange(len(words)) - back
            token = np.where(place >= back, words[np.maximum(at, 0)], START)
            h = fold(h, token)
        out.append(np.where(place >= m - 1, h, np.uint64(0)))
    return out


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows by (first, last) column, sorted, and their summed counts; the others follow from the first."""
    if not len(counts):
        return columns, counts
    by = np.lexsort((columns[-1], columns[0])) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    a, z = columns[0][by], columns[-1][by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (z[1:] != z[:-1])])
    first = np.flatnonzero(new)
    return [c[by][first] for c in columns], np.add.reduceat(counts[by], first)


def _packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Hashes without loss: differences if they ascend, else the distinct ones and places among them; byte planes,
    compressed. The length comes first."""
    import zstandard

    planes = lambda x: zstandard.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)
    if ascending:
        parts = [planes(np.diff(values, prepend=np.uint64(0)))]
    else:
        distinct, places = np.unique(values, return_inverse=True)
        parts = [planes(np.diff(distinct, prepend=np.uint64(0))), planes(places.astype(np.uint32))]
    return b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *parts])


def _unpacked(data: bytes, at: int, ascending: bool = False) -> tuple[np.ndarray, int]:
    """(hashes, where the next part begins)."""
    import zstandard

    sizes = np.frombuffer(data, np.int64, 1 if ascending else 2, at).tolist()
    at += 8 * len(sizes)
    found = []
    for size, kind in zip(sizes, (np.uint64, np.uint32), strict=False):
        raw = np.frombuffer(zstandard.decompress(data[at : at + size]), np.uint8)
        found.append(np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel())
        at += size
    values = np.cumsum(found[0], dtype=np.uint64)
    return (values if ascending else values[found[1]]), at


def _blob(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted by the first column, whose repeats are stored as run lengths when there is another."""
    import zstandard

    heads, runs = np.unique(columns[0], return_counts=True)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]]) if len(runs) else np.zeros(0, np.int64)
    middle = b"".join(_packed(c[first]) for c in columns[1:-1])
    small = zstandard.compress(runs.astype(np.uint32).tobytes(), 1), zstandard.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
    sizes = np.array([len(columns), len(heads), len(counts), len(small[0]), len(small[1])], np.int64).tobytes()
    return b"".join([sizes, _packed(heads, True), middle, _packed(columns[-1]) if len(columns) > 1 else b"", *small])


def _unblob(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    width, n_heads, n, a, b = np.frombuffer(data, np.int64, 5).tolist()
    at = 40
    table, columns = [], []
    for k in range(width):
        values, at = _unpacked(data, at, k == 0)
        (columns if 0 < k == width - 1 else table).append(values)
    runs = np.frombuffer(zstandard.decompress(data[at : at + a]), np.uint32)
    counts = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data[at + a : at + a + b]), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return [*(np.repeat(t, runs) for t in table), *columns], counts


def _blobs(level: int, columns: list[np.ndarray], counts: np.ndarray, bits: int):
    """Rows (level, shard, blob); the columns are sorted by the first one, whose top bits tell the shard."""
    shard = (columns[0] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
    for s in range(1 << bits):
        a, b = cuts[s], cuts[s + 1]
        if a < b:
            yield level, s, _blob([c[a:b] for c in columns], counts[a:b])


def _rows(found) -> pa.RecordBatch:
    levels, shards, data = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(shards, pa.int32()), pa.array(data, pa.binary())], names=["level", "shard", "data"])


def events(texts: DataFrame, order: int, bits: int) -> DataFrame:
    """Blobs of events: level m has columns (context of m - 1 tokens, ..., of 1 token, word); level 0 plain words."""

    def flush(held):
        for level, parts in held.items():
            if parts:
                columns, counts = _summed([np.concatenate(c) for c in zip(*parts, strict=True)], np.ones(sum(len(p[0]) for p in parts), np.int64))
                parts.clear()
                yield from (_rows([b]) for b in _blobs(level, columns, counts, bits))

    def run(batches):
        held: dict[int, list] = {k: [] for k in range(order + 1)}
        n = 0
        for batch in batches:
            for part in pieces(batch, "text", TEXTS):
                words, bounds = tokens(part.column("text"))
                before = contexts(words, bounds, order)
                held[0].append([words])
                whole = before[-1] != 0 if before else np.ones(len(words), bool)
                held[order].append([*(c[whole] for c in reversed(before)), words[whole]])
                for m in range(order - 1, 1, -1):  # events that begin with the start mark
                    some = (before[m - 2] != 0) & (before[m - 1] == 0)
                    held[m].append([*(c[some] for c in reversed(before[: m - 1])), words[some]])
                n += len(words)
                if n >= SORTED:
                    n = 0
                    yield from flush(held)
        yield from flush(held)

    return texts.mapInArrow(run, BLOB)


STATS = "ones bigint, twos bigint, threes bigint, fours bigint, types bigint, total bigint"


def _shard_file(folder: str, level: int, shard: int) -> str:
    return f"{folder}/order{level}-{shard:06d}.kn"


def _small(values: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 or more follow, with their places."""
    large = np.flatnonzero(values >= 255)
    return b"".join([np.array([len(large)], np.int64).tobytes(), large.astype(np.uint32).tobytes(), values[large].astype(np.uint64).tobytes(), np.minimum(values, 255).astype(np.uint8).tobytes()])


class Small:
    """Reads what _small wrote."""

    def __init__(self, take, count: int):
        n = int(take(np.int64, 1)[0])
        self.places, self.large, self.low = take(np.uint32, n), take(np.uint64, n), take(np.uint8, count)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at].astype(np.int64)
        more = np.flatnonzero(out == 255)
        out[more] = self.large[np.searchsorted(self.places, at[more])]
        return out


def _with_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(counts), int(counts.sum())]


def _table(found: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(SCHEMA, zip(*found, strict=True), strict=True)})


def _merged(table: pa.Table, level: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sum of a level's blobs in a group."""
    parts = [_unblob(d.as_buffer().to_pybytes()) for d, k in zip(table.column("data"), table.column("level").to_pylist(), strict=True) if k == level]
    if not parts:
        return [np.zeros(0, np.uint64)] * width, np.zeros(0, np.int64)
    return _summed([np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))


def merge_level(blobs: DataFrame, level: int, folder: str, bits: int) -> DataFrame:
    """Merges the blobs of a level and writes its shards; rows are blobs for the levels below, and statistics."""

    def run(key, table):
        shard = key[0].as_py()
        columns, counts = _merged(table, level, level)
        heads, first, runs = np.unique(columns[0], return_index=True, return_counts=True)
        add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        grams = fold(columns[0], columns[-1])
        by = np.argsort(grams)
        values = [counts[by], add(counts), add(counts == 1), add(counts == 2), runs]
        put(_shard_file(folder, level, shard), b"".join([np.array([len(grams), len(heads)], np.int64).tobytes(), grams[by].tobytes(), heads.tobytes(), *map(_small, values)]))
        found = [(-1, shard, b"", *_with_counts(counts))]
        found += [(*b, *[0] * 6) for b in _blobs(level - 1, *_summed(columns[1:], np.ones(len(counts), np.int64)), bits)]
        for other in range(level):
            found += [(other, shard, _blob(*some), *[0] * 6) for some in [_merged(table, other, max(1, other))] if len(some[1])]
        return _table(found)

    return blobs.groupBy("shard").applyInArrow(run, f"{BLOB}, {STATS}")


SCHEMA = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("data", pa.binary()), *((c, pa.int64()) for c in ("ones", "twos", "threes", "fours", "types", "total"))])


def merge_words(blobs: DataFrame, folder: str) -> DataFrame:
    """Writes the word shards: hashes in order, plain counts, continuation counts; rows of statistics."""

    def run(key, table):
        shard = key[0].as_py()
        (words,), counts = _merged(table, 0, 1)
        (known,), continued = _merged(table, 1, 1)
        full = np.zeros(len(words), np.int64)
        full[np.searchsorted(words, known)] = continued
        put(_shard_file(folder, 1, shard), b"".join([np.array([len(words), 0], np.int64).tobytes(), words.tobytes(), _small(counts), _small(full)]))
        return _table([(-1, shard, b"", *_with_counts(full)), (-2, shard, b"", *_with_counts(counts))])

    return blobs.groupBy("shard").applyInArrow(run, f"{BLOB}, {STATS}")


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """For counts of one, two, and more; the usual constants where the counts of counts can't tell."""
    if not (ones and twos and threes and fours):
        return [0.5, 1.0, 1.5]
    y = ones / (ones + 2 * twos)
    found = [1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1)]


def _statistics(rows: DataFrame, level: int) -> list[int]:
    """ones, twos, threes, fours, types, total over all shards."""
    names = [f.strip().split(" ")[0] for f in STATS.split(",")]
    return list(rows.filter(F.col("level") == level).agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first())


def _present(rows: DataFrame, bits: int) -> str:
    """Which shards have a file, a bit each, in hex."""
    found = np.zeros(1 << max(bits, 3), np.uint8)
    found[[r["shard"] for r in rows.filter("level = -1").select("shard").collect()]] = 1  # one number a shard
    return np.packbits(found).tobytes().hex()


def train(texts: DataFrame, order: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> str:
    """Counts the texts (column text) and writes the model; returns its folder."""
    folder = folder or shared_folder(texts.sparkSession, "ngrams")
    texts = texts.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(1, (max(1, size // shard_bytes) - 1).bit_length())
    state, levels, present = events(texts, order, bits), {}, {}
    for level in range(order, 1, -1):
        rows = written(merge_level(state, level, folder, bits), f"order{level}")
        levels[level], present[level] = _statistics(rows, -1), _present(rows, bits)
        state = rows.filter("level >= 0").select("level", "shard", "data")
    rows = written(merge_words(state, folder), "words")
    levels[1], present[1] = _statistics(rows, -1), _present(rows, bits)
    plain = _statistics(rows, -2)
    meta = {"order": order, "bits": bits, "tokens": plain[5], "words": plain[4], "present": present, "levels": {k: {"discounts": discounts(*v[:4]), "ones": v[0], "twos": v[1], "types": v[4], "total": v[5]} for k, v in levels.items()}}
    put(f"{folder}/model.json", json.dumps(meta).encode())
    return folder


def mapped(url: str) -> np.ndarray:
    """The bytes of a shard, mapped; a shard in a remote store is copied to the worker's disk first, where its file
    has no name, so that the space is free again with the last reader."""
    path = local_path(url)
    if path is not None:
        return np.memmap(path, np.uint8, "r")
    with tempfile.TemporaryFile(prefix="ngrams-") as f:
        f.write(get(url))
        f.flush()
        return np.memmap(f, np.uint8, "r")


class Shard:
    """Sorted hashes and what they stand for."""

    def __init__(self, data: np.ndarray, words: bool):
        n, heads = np.frombuffer(data, np.int64, 2).tolist()
        at = 16

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.heads = take(np.uint64, n), take(np.uint64, heads)
        self.values = [Small(take, n) for _ in range(2 if words else 1)]
        self.head_values = [Small(take, heads) for _ in range(0 if words else 4)]


def _find(keys: np.ndarray, values: list[Small], wanted: np.ndarray) -> list[np.ndarray]:
    """Values of the wanted keys; 0 for those that aren't there."""
    if not len(keys):
        return [np.zeros(len(wanted), np.int64) for _ in values]
    by = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[by] = np.minimum(np.searchsorted(keys, wanted[by]), len(keys) - 1)
    there = keys[at] == wanted
    return [np.where(there, v[at], 0) for v in values]


class Model:
    """A worker's view of a model; shards are mapped when they are first needed."""

    def __init__(self, folder: str):
        self.folder, self.shards = folder, {}
        meta = json.loads(get(f"{folder}/model.json"))
        self.order, self.bits, self.n_tokens, self.n_words = meta["order"], meta["bits"], meta["tokens"], meta["words"]
        self.levels = {int(k): v for k, v in meta["levels"].items()}
        self.present = {int(k): np.unpackbits(np.frombuffer(bytes.fromhex(v), np.uint8)) for k, v in meta["present"].items()}

    def shard(self, level: int, number: int) -> Shard | None:
        """None for a range of hashes without an n-gram; a shard that was written and isn't there is an error."""
        if (level, number) not in self.shards:
            there = self.present[level][number]
            self.shards[level, number] = Shard(mapped(_shard_file(self.folder, level, number)), level == 1) if there else None
        return self.shards[level, number]

    def _by_shard(self, level: int, heads: np.ndarray, width: int, look) -> list[np.ndarray]:
        out = [np.zeros(len(heads), np.int64) for _ in range(width)]
        number = (heads >> np.uint64(64 - self.bits)).astype(np.int64)
        by = np.argsort(number, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(number[by])) + 1):
            shard = self.shard(level, int(number[some[0]])) if len(some) else None
            if shard is not None:
                for o, v in zip(out, look(shard, some), strict=True):
                    o[some] = v
        return out

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(plain counts, probabilities of the lowest order)."""
        plain, continued = self._by_shard(1, words, 2, lambda s, some: _find(s.keys, s.values, words[some]))
        level = self.levels[1]
        uniform = 1 / (self.n_words + 1)
        if not level["total"]:
            return plain, np.full(len(words), uniform)
        d = np.array([0.0, *level["discounts"]])
        left = d[1] * level["ones"] + d[2] * level["twos"] + d[3] * (level["types"] - level["ones"] - level["twos"])
        return plain, (np.maximum(continued - d[np.minimum(continued, 3)], 0) + left * uniform) / level["total"]

    def higher(self, level: int, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        grams = fold(context, word)
        (count,) = self._by_shard(level, context, 1, lambda s, some: _find(s.keys, s.values, grams[some]))
        total, ones, twos, types = self._by_shard(level, context, 4, lambda s, some: _find(s.heads, s.head_values, context[some]))
        d = np.array([0.0, *self.levels[level]["discounts"]])
        left = d[1] * ones + d[2] * twos + d[3] * (types - ones - twos)
        p = (np.maximum(count - d[np.minimum(count, 3)], 0) + left * lower) / np.maximum(total, 1)
        return np.where(total > 0, p, lower)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        words, bounds = tokens(texts)
        distinct, which = np.unique(words, return_inverse=True)
        plain, p = self.words(distinct)
        base = np.log10((plain + 1) / (self.n_tokens + 1 * (self.n_words + 1)))
        prob = p[which]
        for m, context in enumerate(contexts(words, bounds, self.order), 1):
            some = np.flatnonzero(context)
            grams = fold(context[some], words[some])
            _, first, back = np.unique(grams, return_index=True, return_inverse=True)
            at = some[first]
            prob[some] = self.higher(m + 1, context[at], words[at], prob[at])[back]
        starts = bounds[:-1]
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        return {"n_tokens": np.diff(bounds).astype(np.int64), "n_known": add((plain > 0)[which].astype(np.int64)), "base_score": add(base[which]), "score": add(np.log10(prob))}


def scored(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, base_score, score (both log10) and perplexity; the text is dropped.

    A column that has one of these names is replaced.
    """
    outs = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    kept = [c for c in docs.columns if c not in (*outs, text)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(o, T.LongType() if o.startswith("n_") else T.DoubleType()) for o in outs])

    def run(batches):
        model = Model(folder)
        for batch in batches:
            for part in pieces(batch, text, TEXTS):
                got = model.score(part.column(text))
                got["perplexity"] = 10 ** (-got["score"] / got["n_tokens"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(got[o]) for o in outs)], names=[*kept, *outs])

    return docs.mapInArrow(run, schema)
