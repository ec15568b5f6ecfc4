"""Token ids in directly addressable codes.

Ids are cut into chunks of 8 bits, low chunk first. Level 0 holds the low chunk of every id in order; a bitmap
beside it says which ids go on, and level k + 1 holds the next chunks of those. The rank of an id's place
in the bitmap is its place on the next level, and a directory of ranks, one number for each 512 bits, gives
it in constant time. So any id is read with a few array accesses, and nothing is decoded to get there.

A file holds the documents of one range of ids in ascending order:

    magic, number of documents, tokens, levels; offsets of documents (in tokens); ids of documents; then for
    each level its length, its chunks, its bitmap (64-bit words) and its rank directory. All little-endian.

Defined results: a null or empty text gives the end id alone; documents come in ascending id order, null
ids first, repeated ids in order of their texts' digests (equal rows give equal ids, so their order doesn't matter);
an empty table gives no rows; columns other than id and text aren't read, whatever their names. A very long text
is encoded alone and ends its file, so a task needs memory for it or for FILE_TOKENS ids.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import get, local_path, pieces, put, shared_folder, strings, written

MAGIC = b"WDAC0001"
CHUNK = 8
BLOCK_WORDS = 8  # words of a bitmap for each number of the rank directory: 512 bits
#: Documents of a file, about; 0 marks a null id in the file's table of ids.
FILE_DOCS = 4096
#: Tokens at which a file ends early, and bits of its number that count the files of a partition.
FILE_TOKENS, FILE_BITS = 8 << 20, 16
#: Bytes of text that are encoded together.
TOGETHER = 8 << 20
#: Tokens that are read back together.
READ_TOKENS = 1 << 20
#: Entries of a worker's cache before it starts over; bounds its memory, not the result.
REMEMBERED = 800_000


@dataclass
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray
    ranks: np.ndarray

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before the places."""
        word, block = at >> 6, at >> 9
        out = self.ranks[block].astype(np.int64)
        for k in range(BLOCK_WORDS - 1):
            w = (block << 3) + k
            out += np.where(w < word, np.bitwise_count(self.bitmap[np.minimum(w, len(self.bitmap) - 1)]), 0)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.bitmap[word] & below)


def levels_of(ids: np.ndarray) -> list[Level]:
    values, out = ids.astype(np.uint32), []
    while True:
        more = values >> np.uint32(CHUNK)
        goes_on = more != 0
        words = -(-len(values) // (64 * BLOCK_WORDS)) * BLOCK_WORDS
        bits = np.zeros(words * 64, np.uint8)
        bits[: len(values)] = goes_on
        bitmap = np.packbits(bits, bitorder="little").view("<u8")
        upto = np.cumsum(np.bitwise_count(bitmap), dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), upto[BLOCK_WORDS - 1 :: BLOCK_WORDS]]).astype("<u4")
        out.append(Level((values & np.uint32((1 << CHUNK) - 1)).astype(np.uint8), bitmap, ranks))
        if not goes_on.any():
            return out
        values = more[goes_on]


def packed(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file."""
    levels = levels_of(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes()]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes()]
    for level in levels:
        parts += [struct.pack("<Q", len(level.chunks)), level.chunks.tobytes(), level.bitmap.tobytes(), level.ranks.tobytes()]
    return b"".join(parts)


class File:
    """A file of ids, mapped or in memory."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", view, 8)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += out.nbytes
            return out

        self.offsets = take("<i8", docs + 1)
        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0]) if at % 8 == 0 else struct.unpack_from("<Q", take("u1", 8).tobytes())[0]
            words = -(-n // (64 * BLOCK_WORDS)) * BLOCK_WORDS
            self.levels.append(Level(take("u1", n), take("<u8", words), take("<u4", words // BLOCK_WORDS + 1)))

    def at(self, places) -> np.ndarray:
        """The ids at any places, by rank alone."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint64)
        live = np.arange(len(at))
        for k, level in enumerate(self.levels):
            if not len(live):
                break
            out[live] |= level.chunks[at].astype(np.uint64) << np.uint64(CHUNK * k)
            on = (level.bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            live, at = live[on], level.rank(at[on])
        return out

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids of a run of places: the next level's part of a run is a run again."""
        out = np.zeros(b - a, np.uint64)
        live, lo, hi = np.arange(b - a), a, b
        for k, level in enumerate(self.levels):
            if lo >= hi:
                break
            out[live] |= level.chunks[lo:hi].astype(np.uint64) << np.uint64(CHUNK * k)
            bits = np.unpackbits(level.bitmap[lo >> 6 : (hi + 63) >> 6].view(np.uint8), bitorder="little")[lo & 63 :][: hi - lo].astype(bool)
            first = int(level.rank(np.array([lo], np.int64))[0]) if bits.any() else 0
            live = live[bits]
            lo, hi = first, first + len(live)
        return out


def opened(url: str) -> File:
    """A file of the shared folder: mapped where it is mounted, read whole elsewhere."""
    path = local_path(url)
    return File(np.memmap(path, np.uint8, "r") if path else get(url))


class Writer:
    """Takes the documents of a partition in order and writes them as files of a bounded size."""

    def __init__(self, folder: str, part: int, most: int):
        self.folder, self.part, self.most, self.files = folder, part, most, 0
        self._empty()

    def _empty(self) -> None:
        self.names, self.counts, self.chunks, self.tokens = [], [], [], 0

    def add(self, names: list, ends: np.ndarray, flat: np.ndarray):
        """ends are the bounds of the documents in flat; rows of the files that became full."""
        a = 0
        while a < len(names):
            b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + self.most - self.tokens))), len(names))
            self.names += names[a:b]
            self.counts.append(np.diff(ends[a : b + 1]).astype(np.int64))
            self.chunks.append(flat[ends[a] : ends[b]].astype(np.uint32))
            self.tokens += int(ends[b] - ends[a])
            if self.tokens >= self.most:
                yield from self.close()
            a = b

    def close(self):
        if self.names:
            number = self.part << FILE_BITS | self.files
            path = f"{self.folder}/part-{number:012d}.dac"
            put(path, packed(self.names, np.concatenate(self.counts), np.concatenate(self.chunks)))
            yield pa.RecordBatch.from_pydict({"file": [number], "docs": [len(self.names)], "tokens": [self.tokens], "path": [path]})
            self.files += 1
            self._empty()


FILES = "file long, docs long, tokens long, path string"


def write(coded: DataFrame, folder: str, doc_id: str = "doc_id", ids: str = "ids", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes partitions in order of doc_id as files; rows (file, docs, tokens, path).

    coded has to be ranged and sorted by doc_id, ids array<int>. A repeated task writes the same bytes under
    the same names, which are numbers that ascend with doc_id.
    """

    def run(batches):
        from pyspark import TaskContext

        out = Writer(folder, TaskContext.get().partitionId(), file_tokens)
        for batch in batches:
            for part in pieces(batch, ids):
                column = part.column(ids)
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                yield from out.add(part.column(doc_id).to_pylist(), np.concatenate([[0], np.cumsum(counts)]), column.flatten().to_numpy())
        yield from out.close()

    return coded.mapInArrow(run, FILES)


def _documents(path: str):
    """(file, first, last, bounds, ids) for runs of documents of a file, their bounds counted from the run's start."""
    f = opened(path)
    a = 0
    while a < len(f.doc_ids):
        b = min(max(a + 1, int(np.searchsorted(f.offsets, f.offsets[a] + READ_TOKENS, "right")) - 1), a + 512, len(f.doc_ids))
        yield f, a, b, (f.offsets[a : b + 1] - f.offsets[a]), f.between(int(f.offsets[a]), int(f.offsets[b])).astype("<u4")
        a = b


def read(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(file, doc_id, at, ids) of the documents in the files, at counted from the file's first token."""

    def run(batches):
        for batch in batches:
            for number, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
                for f, a, b, ends, flat in _documents(path):
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                    columns = [pa.array([number] * (b - a), pa.int64()), pa.array(f.doc_ids[a:b], pa.int64()), pa.array(f.offsets[a:b].astype(np.int64)), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", doc_id, "at", "ids"])

    return files.select("file", "path").mapInArrow(run, f"file long, {doc_id} long, at long, ids array<int>")


def digests(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files, whose rows have `before`: the tokens of all
    files before. The digest is of the ids as little-endian unsigned 32-bit integers, as they are read back."""

    def run(batches):
        from zlib import crc32

        for batch in batches:
            for before, path in zip(batch.column("before").to_pylist(), batch.column("path").to_pylist(), strict=True):
                for f, a, b, ends, flat in _documents(path):
                    data, cuts = memoryview(flat.tobytes()), (4 * ends).tolist()
                    crc = [crc32(data[x:y]) for x, y in zip(cuts, cuts[1:])]
                    columns = [pa.array(f.doc_ids[a:b], pa.int64()), pa.array(f.offsets[a:b] + before), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "start", "n_tokens", "ids_crc32"])

    return files.select("path", "before").mapInArrow(run, f"{doc_id} long, start long, n_tokens long, ids_crc32 long")


def starts(files: DataFrame) -> DataFrame:
    """The files with `before`: the tokens of all files before. One row a file, summed in two steps."""
    from pyspark.sql import Window as W

    rows = files.select("file", "path", "tokens").withColumn("g", F.shiftright("file", FILE_BITS + 10))
    sums = rows.groupBy("g").agg(F.sum("tokens").alias("t"))
    above = sums.withColumn("base", F.sum("t").over(W.orderBy("g")) - F.col("t")).select(F.col("g").alias("h"), "base")
    inside = rows.withColumn("inner", F.sum("tokens").over(W.partitionBy("g").orderBy("file")) - F.col("tokens"))
    return inside.join(above, F.col("g") == F.col("h")).select("file", "path", (F.col("base") + F.col("inner")).alias("before"))


CLOSING = ".,;:!?"


class Pieces:
    """A worker's tokenizer, and the ids of the runs of visible characters that it has met, in one array.

    White space separates pre-tokens whatever stands around it, and a run of letters is a pre-token. So the
    distinct runs of a batch are encoded once, and one closing mark behind letters is looked up by itself. A text
    that holds the string of a special token goes to the library whole.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.own.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.end = 0
        self._learn(["", *CLOSING])

    def _keep(self, runs: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, end = len(self.known), self.end + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(runs) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.end : end] = ids
        self.starts[n : n + len(runs)], self.sizes[n : n + len(runs)] = self.end + np.cumsum(sizes) - sizes, sizes
        self.known.update(zip(runs, range(n, n + len(runs)), strict=True))
        self.end = end

    def _learn(self, runs: list[str]) -> None:
        plain = [r for r in runs if r.isalpha()]
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            found = self.own.encode(" ".join(some), add_special_tokens=False)
            words, ids = np.array(found.word_ids, np.int64), np.array(found.ids, np.int32)
            cuts = np.flatnonzero(np.diff(words, prepend=-1)) if len(words) else words
            if len(cuts) == len(some) and (np.diff(words) >= 0).all():
                self._keep(some, ids, np.diff(cuts, append=len(ids)))
            else:
                self._alone(some)
        self._alone([r for r in runs if not r.isalpha()])

    def _alone(self, runs: list[str]) -> None:
        for k in range(0, len(runs), 5000):
            some = runs[k : k + 5000]
            found = [e.ids for e in self.own.encode_batch(some, add_special_tokens=False)]
            self._keep(some, np.array([i for f in found for i in f], np.int32), np.fromiter(map(len, found), np.int64, len(found)))

    def places(self, runs: list[str]) -> np.ndarray:
        """Numbers of distinct runs."""
        at = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn([runs[k] for k in new])
            at[new] = [self.known[runs[k]] for k in new]
        return at

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(for each piece the numbers of its run and of its closing mark; bounds of the texts in pieces)."""
        if len(self.known) > REMEMBERED:
            self._clear()
        parts = pc.split_pattern(pc.ascii_lower(texts), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        flat = parts.flatten()
        core = pc.utf8_rtrim(flat, characters=CLOSING)
        behind = (pc.binary_length(flat).to_numpy() - pc.binary_length(core).to_numpy()) if len(flat) else np.zeros(0, np.int64)
        coded = core.dictionary_encode()
        which, cores = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        letters = pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False).astype(bool)
        other = np.flatnonzero(letters & ~pc.string_is_ascii(cores).to_numpy(zero_copy_only=False).astype(bool))
        letters[other] = [c.isalpha() and is_normalized("NFC", c) and c.lower() == c for c in cores.take(pa.array(other)).to_pylist()]
        split = letters[which] & (behind == 1) if len(which) else behind.astype(bool)
        whole = np.flatnonzero((behind > 0) & ~split)
        rest = flat.take(pa.array(whole)).dictionary_encode()
        where = which.copy()
        where[whole] = len(cores) + rest.indices.to_numpy()
        needed = np.zeros(len(cores) + len(rest.dictionary), bool)
        needed[where] = True
        runs = strings(pa.concat_arrays([cores.filter(pa.array(needed[: len(cores)])), rest.dictionary]))
        number = np.zeros(len(needed), np.int64)
        number[needed] = self.places(runs)
        mark = np.full(len(where), self.known[""])
        at = np.flatnonzero(split)
        last = pc.utf8_slice_codeunits(flat.take(pa.array(at)), -1)
        mark[at] = self.places(list(CLOSING))[pc.index_in(last, pa.array(list(CLOSING))).to_numpy(zero_copy_only=False)]
        return np.stack([number[where], mark], axis=1).ravel(), bounds

    def lists(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids) of the texts, each with the end id behind it."""
        texts, held = texts.fill_null(""), np.zeros(len(texts), bool)
        for string in self.special:
            held |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        entire = np.flatnonzero(held)
        apart = [np.array(self.own.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.int32) for k in entire]
        order, bounds = self.batch(pc.if_else(pa.array(held), "", texts) if len(entire) else texts)
        # behind the known runs come the end id and the texts that went whole, each in the place of its one empty piece
        n, extra = len(self.known), [np.array([] if end is None else [end], np.int32), *apart]
        order[2 * bounds[entire]] = n + 1 + np.arange(len(entire))
        order = np.insert(order, 2 * bounds[1:], n)
        lengths = np.array([len(e) for e in extra], np.int64)
        starts = np.concatenate([self.starts[:n], self.end + np.cumsum(lengths) - lengths])
        taken = np.concatenate([self.sizes[:n], lengths])[order]
        ends = np.concatenate([[0], np.cumsum(taken)])
        flat = np.concatenate([self.flat[: self.end], *extra])[np.repeat(starts[order] - ends[:-1], taken) + np.arange(ends[-1])]
        return ends[2 * bounds + np.arange(len(bounds))], flat


@lru_cache(1)
def pieces_of(path: str, special_as_text: bool = False) -> Pieces:
    """One for all tasks of a worker process."""
    return Pieces(path, special_as_text)


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, text: str = "text", special_as_text: bool = False) -> DataFrame:
    """(doc_id, ids) by a file of the tokenizers library and its own settings; with special_as_text the strings of
    special tokens are plain text."""

    def run(batches):
        own = pieces_of(tokenizer, special_as_text)
        for batch in batches:
            for part in pieces(batch, text, 4096, TOGETHER):
                ends, flat = own.lists(part.column(text), end_id)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>")


def stored(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", special_as_text: bool = False, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes and writes all documents in ascending id order; the table of files, written itself.

    Ids go from the tokenizer straight into the codes, so they never pass through the JVM.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "dac")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = max(1, -(-own.count() // FILE_DOCS))
    own = own.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        coder, out = pieces_of(tokenizer, special_as_text), Writer(folder, TaskContext.get().partitionId(), file_tokens)
        for batch in batches:
            for part in pieces(batch, "text", 4096, TOGETHER):
                ends, flat = coder.lists(part.column("text"), end_id)
                yield from out.add(part.column("doc_id").to_pylist(), ends, flat)
        yield from out.close()

    return written(own.mapInArrow(run, FILES), "files")
