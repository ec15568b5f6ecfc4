"""Alignment of two tokenizers' tokens by distinct segments.

A text, with a space before it, is cut into segments before runs of white space, at those white-space characters where no
token of either vocabulary has something visible in front of one (checked when a worker starts). So no merge crosses a
cut, and the tokens of a text are those of its segments in order. Distinct segments are tokenised and aligned once:

1. Texts become blocks of some megabytes (a longer text is one alone). A block is a list of its distinct segments, which
   go on as rows, and a file in the shared folder with the numbers of each document's segments.
2. The blocks' segments are dealt out and sorted by segment. Each distinct one is tokenised and aligned once, and its
   alignment goes back to the blocks that asked for it. A block keeps them in a second file beside the first.
3. The count of a pair needs the documents that hold it: blocks count their documents by pair, the counts are added and
   go back to the blocks, which compose their documents: sums over links are sums over segments, as a cut between
   segments is one between groups.

Only distinct segments and pairs of a block are shuffled, never a row for each word. The commonest segment or pair has one
row for each block that holds it. A file has its task attempt's number, so a task that runs again leaves others alone.

Defined results: no tokens, zeros and an empty alignment for a text that is null or empty, or whose tokens' bytes aren't
those of the space and the text (the second vocabulary reads U+2581 as a space). Strings of special tokens are plain
text. Each row counts as a document, repeated ids and texts too; ties share the highest count. An empty table
gives no rows; columns other than id and text aren't read, whatever their names. A very long text is a block alone, in
memory in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.llm.merge_rounds import byte_symbols
from weftgraph.llm.shared import get, pieces, put, shared_folder, written

#: Bytes of text of a block, and bits of its number that count the blocks of a task.
BLOCK_BYTES, BLOCK_BITS = 12 << 20, 20
#: Documents and bytes of text of a block that are worked on together.
SLICE_DOCS, SLICE_BYTES = 4096, 1 << 19
#: Rows of segments that are aligned together.
TOGETHER = 8192
#: White space before which a text may be cut, if the vocabularies allow it.
CUTS = " \n\t\r\v\f"
SPACE = "▁"
#: From here on numbers need 32 bits; what stands before those.
WIDE, MARK = 0xFFFF, b"\xff\xff"
#: Ids of the second vocabulary that share a row of counts, as bits.
ROW_BITS = 12


class Two:
    """The two tokenizers, the bytes of their tokens, and where both may be cut."""

    def __init__(self, byte_level: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=piece_model)
        self.a.encode_special_tokens = True
        bytes_of = {ord(s): k for k, s in enumerate(byte_symbols())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[number] = token.translate(bytes_of).encode("latin-1")
        kinds = range(self.b.get_piece_size())
        names = [self.b.id_to_piece(i) for i in kinds]
        self.b_bytes = [bytes([int(names[i][3:5], 16)]) if self.b.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in kinds]
        self.b_space = self.b.piece_to_id(SPACE)
        self.a_size, self.b_size = (np.array([len(t) for t in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        # no token may hold w behind something visible; the second vocabulary puts a space before what it reads, so w can't stand behind that either
        texts = [t.decode("utf-8", "replace") for t in self.a_bytes] + [p.replace(SPACE, " ") for p in names]
        self.cuts = "".join(w for w in CUTS if not any(re.search(rf"\S{re.escape(w)}", t) for t in texts) and (w == " " or not any(f"{SPACE}{w}" in p for p in names)))
        if " " not in self.cuts:
            raise ValueError("these vocabularies merge across spaces")
        # white space and what is visible up to the next place to cut at
        self.segments = re.compile(rf"\s*\S+(?:[^\S{re.escape(self.cuts)}]\s*\S*)*|\s+").findall

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that starts with white space of `cuts`, by both."""
        first = self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            return first, [self.b_space]
        # the space that the second vocabulary would add is there already, or is taken off again
        return first, self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def aligned(self, segments: list[str]) -> list[bytes]:
        """The alignment of each segment as packed by `_pack`; nothing where the bytes aren't the segment's."""
        at = [k for k, s in enumerate(segments) if not s[-1].isspace()]  # these may follow one another
        done = dict(zip(at, self._together([segments[k] for k in at]), strict=True)) if at else {}
        return [done[k] if k in done else self._together([s])[0] for k, s in enumerate(segments)]

    def _together(self, segments: list[str]) -> list[bytes]:
        text = "".join(segments)
        raw, (a, b) = text.encode("utf-8", "surrogatepass"), self._ids(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            if len(segments) == 1:
                return [b""]
            half = len(segments) // 2
            return self._together(segments[:half]) + self._together(segments[half:])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in segments])
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        return _pack(ends, a, a_ends, b, b_ends, cuts)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for each start as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _pack(ends, a, a_ends, b, b_ends, cuts) -> list[bytes]:
    """For each segment, as 16-bit integers: how many ids of a, ids of b and groups it has; the ids of a, those of b; how
    many ids of a each group has, and how many of b. A segment with larger numbers has 32-bit ones behind a mark."""
    upto_a, upto_b, upto_g = (np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, cuts))
    n_a, n_b, n_g = (np.diff(x, prepend=0) for x in (upto_a, upto_b, upto_g))
    sizes = 3 + n_a + n_b + 2 * n_g
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int32)
    for k, n in enumerate((n_a, n_b, n_g)):
        out[start + k] = n
    out[_places(start + 3, n_a)] = a
    out[_places(start + 3 + n_a, n_b)] = b
    out[_places(start + 3 + n_a + n_b, n_g)] = np.diff(np.searchsorted(a_ends, cuts, "right"), prepend=0)
    out[_places(start + 3 + n_a + n_b + n_g, n_g)] = np.diff(np.searchsorted(b_ends, cuts, "right"), prepend=0)
    bounds = np.append(start, len(out)).tolist()
    if out.max(initial=0) < WIDE:
        raw = out.astype("<u2").tobytes()
        return [raw[2 * x : 2 * y] for x, y in zip(bounds, bounds[1:], strict=False)]
    some = (out[x:y] for x, y in zip(bounds, bounds[1:], strict=False))
    return [x.astype("<u2").tobytes() if x.max() < WIDE else MARK + x.astype("<i4").tobytes() for x in some]


class Parts:
    """The alignments of a block's segments, by number, out of their packed forms."""

    def __init__(self, packed: pa.Array):
        offsets, raw = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, 8 * packed.offset), packed.buffers()[2]
        first, end = (int(offsets[0]), int(offsets[-1])) if len(packed) else (0, 0)
        flat, sizes = np.frombuffer(raw, "<u2", (end - first) // 2, first).astype(np.int32) if end > first else np.zeros(0, np.int32), np.diff(offsets) // 2
        start = np.cumsum(sizes) - sizes
        if (wide := np.flatnonzero((sizes > 0) & (flat[np.minimum(start, max(len(flat) - 1, 0))] == WIDE) if len(flat) else [])).size:
            some = [flat[x : x + n] for x, n in zip(start.tolist(), sizes.tolist(), strict=True)]
            for k in wide.tolist():
                some[k] = np.frombuffer(raw, "<i4", (int(sizes[k]) - 1) // 2, first + 2 * int(start[k]) + 2)
            flat, sizes = np.concatenate(some), np.array([len(x) for x in some])
        self.valid = sizes > 0
        start = (np.cumsum(sizes) - sizes)[self.valid]
        counts = [np.zeros(len(sizes), np.int64) for _ in range(3)]
        for k, c in enumerate(counts):
            c[self.valid] = flat[start + k]
        self.n_a, self.n_b, self.n_g = counts
        n_a, n_b, n_g = (c[self.valid] for c in counts)
        self.a, self.b = flat[_places(start + 3, n_a)], flat[_places(start + 3 + n_a, n_b)]
        self.in_a, self.in_b = (flat[_places(start + 3 + n_a + n_b + k * n_g, n_g)] for k in (0, 1))
        del flat
        per_group = self.in_a * self.in_b
        upto = np.concatenate([[0], np.cumsum(per_group, dtype=np.int64)])
        groups = np.cumsum(self.n_g)
        self.n_links = upto[groups] - upto[groups - self.n_g]
        k = np.arange(int(upto[-1]), dtype=np.int32) - np.repeat(upto[:-1].astype(np.int32), per_group)
        width = np.repeat(self.in_b, per_group)
        at_a, at_b = k // width, k % width
        del k, width
        at_a += np.repeat((np.cumsum(self.in_a) - self.in_a).astype(np.int32), per_group)
        at_b += np.repeat((np.cumsum(self.in_b) - self.in_b).astype(np.int32), per_group)
        #: (id of a) << 32 | id of b of all links, in order; those of segment k are n_links[k] of them.
        self.links = self.a[at_a].astype(np.int64) << 32
        self.links |= self.b[at_b]

    def shown(self) -> pa.Array:
        """a1,a2|b1;a3|b2,b3; of each segment, with the mark behind its last group."""
        order = np.argsort(np.concatenate([np.repeat(2 * np.arange(len(self.in_a)), self.in_a), np.repeat(2 * np.arange(len(self.in_b)) + 1, self.in_b)]), kind="stable")
        most = int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1
        last = [np.zeros(len(x), np.int32) for x in (self.a, self.b)]
        for mark, x in zip(last, (self.in_a, self.in_b), strict=True):
            mark[np.cumsum(x) - 1] = 1
        which = np.concatenate([self.a + most * last[0], self.b + most * 2 * last[1]])[order]
        texts = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], pa.large_binary()).take(pa.array(which))
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
        places = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return pa.Array.from_buffers(pa.large_binary(), len(self.n_a), [None, pa.py_buffer(offsets[places].tobytes()), texts.buffers()[2]])


@lru_cache(1)
def both(byte_level: str, piece_model: str) -> Two:
    """One for all tasks of a worker process."""
    return Two(byte_level, piece_model)


class Numbering(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _put(url: str, batches: list[pa.RecordBatch]) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    put(url, sink.getvalue())


def _get(url: str) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_file(pa.py_buffer(get(url))) as f:
        for k in range(f.num_record_batches):
            yield f.get_batch(k)


def blocks(docs: DataFrame, two: tuple[str, str], folder: str, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, segments), written: the distinct segments of each block. Its documents are in the folder, by its number."""

    def run(batches):
        from pyspark import TaskContext

        find, block = both(*two).segments, TaskContext.get().taskAttemptId() << BLOCK_BITS
        known, held, upto = Numbering(), [], 0

        def close():
            nonlocal known, held, upto, block
            _put(f"{folder}/{block}.docs", held)
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([list(known)], pa.list_(pa.string()))], names=["block", "segments"])
            known, held, upto, block = Numbering(), [], 0, block + 1
            pa.default_memory_pool().release_unused()
            return out

        for batch in batches:
            for part in pieces(batch, "text", SLICE_DOCS, SLICE_BYTES):
                number = known.__getitem__
                codes = [np.array(list(map(number, find(" " + t))), np.int32) if t else np.zeros(0, np.int32) for t in part.column("text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
                held.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(codes)))], names=["doc_id", "codes"]))
                upto += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if upto >= size:
                    yield close()
        if held:
            yield close()

    return written(docs.mapInArrow(run, "block long, segments array<string>"), "blocks")


PARTS = "block long, codes array<int>, sizes array<int>, packed binary"


def aligned_segments(places: DataFrame, two: tuple[str, str]) -> DataFrame:
    """Alignments of places (block, code, segment), each distinct segment aligned once. The places of a block that come
    together share a row: their numbers, the sizes of their packed alignments, and these one behind the other."""

    def run(batches):
        own, before, packed = both(*two), None, b""
        for batch in batches:
            for part in pieces(batch, "segment", TOGETHER):
                coded = part.column("segment").dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                new = distinct[1:] if distinct[0] == before else distinct
                done = [packed] * (len(distinct) - len(new)) + own.aligned(new)
                before, packed = distinct[-1], done[-1]
                block = part.column("block").to_numpy()
                order = np.argsort(block, kind="stable")
                first = np.flatnonzero(np.diff(block[order], prepend=-1))
                rows = pa.array(done, pa.binary()).take(coded.indices.take(pa.array(order)))
                offsets = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1)
                bounds = pa.array(np.append(first, len(rows)), pa.int32())
                joined = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets[np.append(first, len(rows))].tobytes()), rows.buffers()[2]])
                lists = [pa.ListArray.from_arrays(bounds, x) for x in (part.column("code").take(pa.array(order)), pa.array(np.diff(offsets)))]
                yield pa.RecordBatch.from_arrays([pa.array(block[order][first]), *lists, joined], names=["block", "codes", "sizes", "packed"])

    dealt = places.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, PARTS)


def _by_code(rows: pa.Table) -> pa.Array:
    """The packed alignments of a block's rows in the order of their numbers."""
    codes, sizes = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("codes", "sizes"))
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    raw = pa.py_buffer(b"".join(rows.column("packed").to_pylist()))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), raw]).take(pa.array(np.argsort(codes)))


COUNTS = "block long, a long, g int, b array<int>, documents array<int>"


def _counted(folder: str):
    """How many documents of a block hold each pair linked, a row for some of the pairs of an id; keeps the block's
    alignments in the folder."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        packed = _by_code(rows)
        _put(f"{folder}/{block}.parts", [pa.RecordBatch.from_arrays([packed], names=["packed"])])
        parts = Parts(packed)
        pairs, which = np.unique(parts.links, return_inverse=True)
        which, parts.links = which.astype(np.int32), None
        counts, starts, n = np.zeros(len(pairs), np.int32), np.cumsum(parts.n_links) - parts.n_links, max(1, len(parts.valid))
        for batch in _get(f"{folder}/{block}.docs"):
            _, flat, fine, document = _documents(batch, parts)
            held = np.unique((document * n + flat)[fine[document]])  # each segment once a document
            document, code = held // n, held % n
            at = _places(starts[code], parts.n_links[code])
            once = np.unique(np.repeat(document, parts.n_links[code]) * max(1, len(pairs)) + which[at])
            counts += np.bincount(once % max(1, len(pairs)), minlength=len(pairs)).astype(np.int32)
        del parts, which, packed, rows
        pa.default_memory_pool().release_unused()
        held = counts > 0
        pairs, counts = pairs[held], counts[held]
        first = np.flatnonzero(np.diff(pairs >> ROW_BITS, prepend=-1))
        bounds = pa.array(np.append(first, len(pairs)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (pairs & 0xFFFFFFFF, counts)]
        ids = [pa.array([block] * len(first), pa.int64()), pa.array(pairs[first] >> 32, pa.int64()), pa.array((pairs[first] & 0xFFFFFFFF) >> ROW_BITS, pa.int32())]
        return pa.table([*ids, *lists], names=["block", "a", "g", "b", "documents"])

    return run


def _documents(batch: pa.RecordBatch, parts: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, segments, whether a document has tokens, the document of each segment)."""
    codes = batch.column("codes")
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    wrong = np.concatenate([[0], np.cumsum(~parts.valid[flat])])
    return ends, flat, (wrong[ends[1:]] == wrong[ends[:-1]]) & (sizes > 0), np.repeat(np.arange(len(sizes)), sizes)


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
ROWS = ", ".join(["doc_id long", *(f"{n} long" for n in SUMS), "groups string"])


def _composed(folder: str):
    """The documents of a block, from its files and the counts of its pairs over all documents."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        block, lists = key[0].as_py(), [rows.column(c).combine_chunks() for c in ("b", "totals")]
        b, counts = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        per_row = lists[0].value_lengths().to_numpy(zero_copy_only=False)
        a, most = (np.repeat(rows.column(c).to_numpy(), per_row) for c in ("a", "most"))
        pairs = a << 32 | b
        order = np.argsort(pairs)
        pairs, counts, best = pairs[order], counts[order], (counts == most)[order]
        if not len(pairs):
            pairs, counts, best = np.array([-1]), np.array([0]), np.array([False])
        parts = Parts(next(_get(f"{folder}/{block}.parts")).column("packed"))
        at = np.minimum(np.searchsorted(pairs, parts.links), len(pairs) - 1)
        known = pairs[at] == parts.links  # others are only in texts without tokens
        upto = [np.concatenate([[0], np.cumsum(np.where(known, x, 0))]) for x in (best[at].astype(np.int64), counts[at])]
        ends, parts.links = np.cumsum(parts.n_links), None
        sums = dict(zip(SUMS, (parts.n_a, parts.n_b, parts.n_g, parts.n_links, *(u[ends] - u[ends - parts.n_links] for u in upto)), strict=True))
        shown = parts.shown()
        for batch in _get(f"{folder}/{block}.docs"):
            bounds, flat, fine, _ = _documents(batch, parts)
            out = {"doc_id": batch.column("doc_id")}
            for name, values in sums.items():
                total = np.concatenate([[0], np.cumsum(values[flat])])
                out[name] = pa.array(np.where(fine, total[bounds[1:]] - total[bounds[:-1]], 0), pa.int64())
            taken = shown.take(pa.array(flat))
            offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[bounds]
            texts = pa.Array.from_buffers(pa.large_binary(), len(fine), [None, pa.py_buffer(offsets.tobytes()), taken.buffers()[2]])
            texts = pc.if_else(pa.array(fine), pc.binary_slice(texts, 0, -1), pa.scalar(b"", pa.large_binary()))
            out["groups"] = texts.cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        del parts, shown, sums
        pa.default_memory_pool().release_unused()

    return run


def align(docs: DataFrame, byte_level: str, piece_model: str, text: str = "text", doc_id: str = "doc_id", size: int = BLOCK_BYTES) -> DataFrame:
    """For each document doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest count of
    its first id), count_sum (the pairs' counts, summed over links) and groups: a1,a2|b1;a3|b2,b3 in order."""
    two, folder = (byte_level, piece_model), shared_folder(docs.sparkSession, "alignment")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = blocks(own, two, folder, size)
    parts = aligned_segments(cut.select("block", F.posexplode("segments").alias("code", "segment")), two)
    # a row of its own, so that a block without segments or pairs isn't lost
    none = [F.array().cast("array<int>").alias(x) for x in ("x", "y")]
    parts = parts.unionByName(cut.select("block", none[0].alias("codes"), none[1].alias("sizes"), F.lit(b"").alias("packed")))
    counted = parts.groupBy("block").applyInArrow(_counted(folder), COUNTS).repartition("a", "g")
    each = counted.select("block", "a", "g", F.explode(F.arrays_zip("b", "documents")).alias("p")).select("block", "a", "g", "p.b", "p.documents")
    each = each.withColumn("total", F.sum("documents").over(W.partitionBy("a", "g", "b")))  # at most a row a block
    lists = each.groupBy("block", "a", "g").agg(F.collect_list(F.struct("b", "total")).alias("p"))  # 2 ** ROW_BITS at most
    totals = written(lists.select("block", "a", F.col("p.b").alias("b"), F.col("p.total").alias("totals")), "pairs")
    highest = totals.groupBy("a").agg(F.max(F.array_max("totals")).alias("most"))  # a row for each id of the first vocabulary at most
    known = totals.join(F.broadcast(highest), "a").select("block", "a", "b", "totals", "most")
    missing = cut.select("block", F.lit(0).cast("long").alias("a"), none[0].alias("b"), none[1].cast("array<long>").alias("totals"), F.lit(0).cast("long").alias("most"))
    return known.unionByName(missing).groupBy("block").applyInArrow(_composed(folder), ROWS)
