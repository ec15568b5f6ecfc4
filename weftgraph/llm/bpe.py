"""Byte-level BPE with a rank queue built on a hierarchical bitmap.

Each merge rank owns a bucket of positions in the linked list of symbols. A two-level bitmap over the
ranks tells which buckets hold anything; find-first-set on both levels gives the lowest rank, whose
positions are merged from left to right. Entries that an earlier merge made invalid stay where they are
and are skipped when they come up, so n bytes take O(n log n) however long a pre-token is. The list holds
all pre-tokens that a batch of texts brings for the first time, with gaps between them.

Defined results: a null text is the empty text and has no ids; ids that are null or not in the
vocabulary decode to nothing, as does a null list. Rows, order of columns and repeated rows are kept, so equal
texts get equal ids; an empty table gives no rows; a column that has the name of an output is replaced. A very
long text is worked on alone, in memory in proportion to it.
"""

from __future__ import annotations

import base64
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.shared import pieces, strings

#: Bits of a word of the lower bitmap level; the upper level has one bit for each word.
WORD_BITS = 8
#: Entries of a worker's cache before it starts over; bounds its memory, not the result.
REMEMBERED = 600_000
#: Texts whose new pre-tokens go through the queue together.
TOGETHER = 2000
#: A lone space between two visible characters always starts a new pre-token.
CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}


class RankQueue:
    """Positions by merge rank; lowest() takes out the whole bucket of the lowest rank, leftmost first."""

    def __init__(self, n_ranks: int):
        self.words = [0] * ((n_ranks >> WORD_BITS) + 1)
        self.summary = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        word = rank >> WORD_BITS
        self.words[word] |= 1 << (rank & ((1 << WORD_BITS) - 1))
        self.summary |= 1 << word

    def lowest(self) -> tuple[int, list[int]]:
        word = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[word]
        rank = (word << WORD_BITS) | ((bits & -bits).bit_length() - 1)
        self.words[word] = bits & (bits - 1)
        if not self.words[word]:
            self.summary &= self.summary - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Encoder:
    """Texts to ids, packed as int32 in the machine's order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens: dict[str, bytes] = {}  # pre-token -> packed ids
        # The Rust engine's \s is the White_Space property; Python's adds four control characters.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.shift = max(ranks.values()).bit_length()
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[(left << self.shift) | right] = rank

    def merge(self, pre_tokens: list[bytes]) -> list[bytes]:
        """Packed ids of each. All lie in one linked list, with a gap that no merge crosses after each."""
        shift, pair, queue, buckets = self.shift, self.pairs.get, self.queue, self.queue.buckets
        ids: list[int] = []
        starts = []
        single = self.single.__getitem__
        for t in pre_tokens:
            starts.append(len(ids))
            whole = self.ranks.get(t)
            ids += [whole] if whole is not None else map(single, t)
            ids.append(-1)
        starts.append(len(ids))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = [-1] * n  # rank of the pair that starts here; -1: none
        for i, (left, right) in enumerate(pairwise(ids)):
            if left >= 0 and right >= 0:
                rank = pair((left << shift) | right)
                if rank is not None:
                    at[i] = rank
                    bucket = buckets.get(rank)
                    if bucket is None:
                        queue.open(rank, [i])
                    else:
                        bucket.append(i)
        while queue.summary:
            rank, positions = queue.lowest()
            for done, i in enumerate(positions, 1):
                if at[i] != rank:
                    continue  # stale
                gone = after[i]
                right, left = after[gone], before[i]
                ids[i], ids[gone], at[gone], after[i] = rank, -2, -1, right
                before[right] = i
                lower = False
                other = ids[right]
                new = pair((rank << shift) | other) if other >= 0 else None
                if new is None:
                    at[i] = -1
                else:
                    at[i] = new
                    lower = new < rank
                    bucket = buckets.get(new)
                    if bucket is None:
                        queue.open(new, [i])
                    else:
                        bucket.append(i)
                other = ids[left] if left >= 0 else -1
                if other >= 0:
                    new = pair((other << shift) | rank)
                    if new is None:
                        at[left] = -1
                    else:
                        at[left] = new
                        lower |= new < rank
                        bucket = buckets.get(new)
                        if bucket is None:
                            queue.open(new, [left])
                        else:
                            bucket.append(left)
                if lower:  # a merge made a pair that comes before the rest of this bucket
                    if done < len(positions):
                        queue.open(rank, positions[done:])
                    break
        flat = np.array(ids, np.int32)
        kept = np.concatenate([[0], np.cumsum(flat >= 0)])
        packed, ends = flat[flat >= 0].tobytes(), (kept[starts] * 4).tolist()
        return [packed[a:b] for a, b in pairwise(ends)]

    def learn(self, tokens: set[str]) -> None:
        if len(self.tokens) > REMEMBERED:
            self.tokens.clear()
        new = list(tokens - self.tokens.keys())
        self.tokens.update(zip(new, self.merge([t.encode("utf-8", "surrogatepass") for t in new]), strict=True))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): the ids of text k are ids[ends[k]:ends[k + 1]].

        Texts are cut at single spaces, and each distinct piece is matched against the pattern once. A text
        in which white space meets white space is cut only where a lone space stands between visible ones.
        """
        parts = pc.split_pattern(texts.fill_null(""), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        which, distinct = coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary)
        unclean = np.array([not p or p[0].isspace() or p[-1].isspace() for p in distinct], bool)
        meets = unclean[which]
        heads = [distinct[k] for k in which[bounds[:-1]]]
        meets[bounds[:-1]] = [not h or h[-1].isspace() for h in heads]
        careful = np.flatnonzero(np.logical_or.reduceat(meets, bounds[:-1]) & (np.diff(bounds) > 1)) if len(heads) else []
        found = [() if bad else self.find(" " + p) for p, bad in zip(distinct, unclean, strict=True)]
        found += map(self.find, heads)
        for k in careful:
            first, *rest = CLEAN_SPACE.split(texts[int(k)].as_py())
            found[len(distinct) + k] = [*self.find(first), *(t for piece in rest for t in self.find(" " + piece))]
        self.learn(set().union(*found))
        of = self.tokens.__getitem__
        packed = [b"".join(map(of, f)) for f in found]
        which[bounds[:-1]] = len(distinct) + np.arange(len(heads))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.cumsum(sizes) - sizes
        taken = sizes[which]
        for k in careful:
            taken[bounds[k] + 1 : bounds[k + 1]] = 0
        ends = np.concatenate([[0], np.cumsum(taken)])
        ids = np.frombuffer(b"".join(packed), np.int32)[np.repeat(starts[which] - ends[:-1], taken) + np.arange(ends[-1])]
        return ends[bounds], ids

    def encode(self, text: str | None) -> list[int]:
        return self.batch(pa.array([text], pa.string()))[1].tolist()


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = batch.schema.names
    columns = [column if n == name else batch.column(i) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns if name in names else [*columns, column], names if name in names else [*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    fields = [T.StructField(name, kind) if f.name == name else f for f in df.schema.fields]
    return T.StructType(fields if name in df.columns else [*fields, T.StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of the texts as array<int>. No shuffle; a worker holds one Arrow batch and its cache."""

    def run(batches):
        encoder = Encoder(read_ranks(ranks_path), pattern)
        for batch in batches:
            for part in pieces(batch, text, TOGETHER):
                ends, flat = encoder.batch(part.column(text))
                yield _with(part, ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


class Decoder:
    """The vocabulary as one Arrow array; ids that it hasn't got stand for nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values()) + 1
        tokens = [b""] * (self.none + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())

    def batch(self, lists: pa.Array) -> pa.Array:
        """The bytes of each list of ids: tokens are taken in one step, and their bytes already lie in order."""
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        taken = self.tokens.take(pa.array(np.where((ids >= 0) & (ids < self.none), ids, self.none)))
        _, offsets, data = taken.buffers()
        places = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        bounds = np.frombuffer(offsets, np.int32, len(taken) + 1)[places]
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds.tobytes()), data])


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""

    def run(batches):
        decoder = Decoder(read_ranks(ranks_path))
        for batch in batches:
            for part in pieces(batch, ids, TOGETHER):
                yield _with(part, out, decoder.batch(part.column(ids)))

    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))
