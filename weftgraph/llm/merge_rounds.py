"""BPE by rounds of merges over many words at once, in NumPy.

The symbols of all new words of a batch lie in one flat array. A pair of neighbours is a 64-bit key, and its rank is
found by binary search over the sorted keys of all merges. In a round each word merges its lowest-ranked pair, at all
its places from left to right; then only the ranks beside merged places are looked up again, and words without a pair
left are taken out.

In a word longer than a window (the symbols of the longest token on each side) a place is merged as soon as no pair in
its window has a lower rank: whatever could take a symbol of it away first would begin with such a pair. So a very long
word needs about as many rounds as a window has places, not as it has pairs.

White space separates words whatever stands around it, so texts are cut at single spaces and each distinct run is
worked on once in a while by a worker, by the tokenizer file's normalizer and pattern. Decoding is that of the library for a
file without a decoder: token strings joined by spaces.

Defined results: a null text is the empty text and has no ids; strings of special tokens in a text become those tokens,
as in the library, or plain text with special_as_text; ids that are null or unknown decode to nothing, as does a null
list. Rows, order of columns and repeated rows are kept, so equal texts get equal ids; of pairs of equal rank the left
one comes first; an empty table gives no rows; a column that has the name of an output is replaced. A very long text is
worked on alone, in memory in proportion to it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.shared import pieces, strings

#: Bytes of text that are encoded together.
TOGETHER = 2 << 20
#: Runs in a worker's cache before it starts over; bounds its memory, not the result.
REMEMBERED = 250_000
#: New runs that are merged together.
NEW = 20_000
#: No merge.
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a vocabulary, and the rounds."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in merges]
        self.suffix, self.shift = suffix, max(vocabulary.values()).bit_length()
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << self.shift | right
        keys, first = np.unique(keys, return_index=True)
        self.keys = np.append(keys, np.int64(-1)) if not len(keys) else keys
        self.ranks = np.arange(len(pairs), dtype=np.int32)[first] if len(keys) else np.array([NONE])
        # the second half of a merged token goes without a prefix, so the halves are simply joined
        self.merged = np.array([vocabulary[a + b] for a, b in pairs] or [0], np.int32)
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int32)
        self.last = np.array([vocabulary[s + suffix] for s in symbols], np.int32)
        self.window = max(len(t.removesuffix(suffix) if suffix else t) for t in vocabulary)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search."""
        keys = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); words aren't empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        long = (sizes > 2 * self.window)[word]
        done = [self._rounds(ids[~long], word[~long], False)] + ([self._rounds(ids[long], word[long], True)] if long.any() else [])
        ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _rounds(self, ids: np.ndarray, word: np.ndarray, by_window: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their words) after all merges."""
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.rank(ids[inside], ids[inside + 1])
        while len(ids):
            low = self._by_window(rank) if by_window else self._by_word(rank, word)
            live = low != NONE
            if not live.any():
                break
            if not by_window and 2 * np.count_nonzero(live) < len(ids):
                finished.append((ids[~live], word[~live]))
                ids, word, rank, low = ids[live], word[live], rank[live], low[live]
            at = self._from_left(rank, (rank == low) & (rank != NONE))
            ids[at] = self.merged[rank[at]]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            at -= np.arange(len(at))  # each merge before has taken one place
            ids, word, rank = ids[kept], word[kept], rank[kept]
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[near] = NONE
            near = near[near + 1 < len(ids)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.rank(ids[near], ids[near + 1])
        finished.append((ids, word))
        return tuple(np.concatenate(x) for x in zip(*finished, strict=True))

    @staticmethod
    def _by_word(rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """At each place the lowest rank of its word."""
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        return np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(rank)))

    def _by_window(self, rank: np.ndarray) -> np.ndarray:
        """At each place the lowest rank within a window on both sides, by doubling."""
        span, width = 2 * self.window + 1, 1
        low = np.concatenate([np.full(self.window, NONE), rank, np.full(self.window, NONE)])
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        return low

    @staticmethod
    def _from_left(rank: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Places to merge. Of overlapping places (a chain of the same pair) every second one from the chain's start,
        as far as all before are lowest."""
        at = np.arange(len(rank))
        fresh = np.ones(len(rank), bool)
        fresh[1:] = rank[1:] != rank[:-1]
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        stop = np.maximum.accumulate(np.where(lowest, -1, at))
        return np.flatnonzero(lowest & (stop < start) & ((at - start) % 2 == 0))


class Encoder:
    """Texts to ids by a tokenizer file, with a worker's memory of the runs that it has met."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.normal, self.cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.special = {} if special_as_text else {t.content: i for i, t in own.get_added_tokens_decoder().items()}
        self.apart = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.bytes_of = {ord(s): b for b, s in enumerate(byte_symbols())}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(2, np.int64)

    def _words(self, run: str) -> list[bytes]:
        return [w.translate(self.bytes_of).encode("latin-1") for w, _ in self.cut(self.normal(run))]

    def _learn(self, runs: list[str]) -> None:
        split = [self._words(r) for r in runs]
        words = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        ids, sizes = self.merges.encode(list(words)) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        flat, ends = _gather(ids, np.concatenate([[0], np.cumsum(sizes)]), which)
        n = len(self.known)
        self.known.update(zip(runs, range(n, n + len(runs)), strict=True))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends[np.cumsum(counts)]])
        self.flat = np.concatenate([self.flat, flat])

    def _numbers(self, runs: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(at < 0)
        new = list(dict.fromkeys(runs[k] for k in missing.tolist()))
        for k in range(0, len(new), NEW):
            self._learn(new[k : k + NEW])
        at[missing] = [self.known[runs[k]] for k in missing.tolist()]
        return at

    def _with_special(self, text: str) -> np.ndarray:
        parts, out = self.apart.split(text), []
        for part in filter(None, parts):
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32))
            else:
                which = self._numbers(part.split(" "))
                out.append(_gather(self.flat, self.bounds, which)[0])
        return np.concatenate(out)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of text k are ids[bounds[k]:bounds[k + 1]]."""
        if len(self.known) > REMEMBERED:
            self._clear()
        texts = texts.fill_null("")
        held = np.zeros(len(texts), bool)
        for string in self.special:
            held |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        entire = np.flatnonzero(held)
        parts = pc.split_pattern(pc.if_else(pa.array(held), "", texts) if len(entire) else texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        which = self._numbers(strings(coded.dictionary))[coded.indices.to_numpy()]
        apart = [self._with_special(texts[int(k)].as_py()) for k in entire]
        # texts with special tokens come behind the known runs, each in the place of its one empty run
        which[bounds[entire]] = len(self.known) + np.arange(len(entire))
        sizes = np.array([len(a) for a in apart], np.int64)
        flat, ends = _gather(np.concatenate([self.flat, *apart]), np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)]), which)
        return ends[bounds], flat

    def encode(self, text: str | None) -> list[int]:
        return self.batch(pa.array([text], pa.string()))[1].tolist()


def _gather(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lists of these numbers one behind the other, their bounds)."""
    sizes = np.diff(bounds)[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(bounds[:-1][which] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Decoder:
    """Token strings, each with the space behind it, in one Arrow array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        known = {i: t for t, i in own.get_vocab(with_added_tokens=True).items()}
        self.none = max(known) + 1
        self.tokens = pa.array([f"{known[i]} ".encode() if i in known else b"" for i in range(self.none + 1)], pa.binary())

    def batch(self, lists: pa.Array) -> pa.Array:
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        taken = self.tokens.take(pa.array(np.where((ids >= 0) & (ids < self.none), ids, self.none)))
        offsets, data = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1), taken.buffers()[2]
        places = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        joined = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets[places].tobytes()), data])
        return pc.binary_slice(joined, 0, -1)


@lru_cache(1)
def encoder_of(path: str, special_as_text: bool) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path, special_as_text)


def _replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    rows = {name: columns.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)} | columns
    return pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))


def _schema(df: DataFrame, kinds: dict[str, T.DataType]) -> T.StructType:
    fields = [T.StructField(f.name, kinds[f.name]) if f.name in kinds else f for f in df.schema.fields]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in kinds.items() if name not in df.columns])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", packed: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Adds the ids of the texts as array<int>, and on demand as little-endian 32-bit integers. No shuffle."""

    def run(batches):
        encoder = encoder_of(tokenizer, special_as_text)
        for batch in batches:
            for part in pieces(batch, text, 4096, TOGETHER):
                ends, flat = encoder.batch(part.column(text))
                columns = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}
                if packed:
                    columns[packed] = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
                yield _replaced(part, columns)

    return df.mapInArrow(run, _schema(df, {ids: T.ArrayType(T.IntegerType())} | ({packed: T.BinaryType()} if packed else {})))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text, in UTF-8, that the ids stand for."""

    def run(batches):
        decoder = Decoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, ids, 4096, TOGETHER // 4):
                yield _replaced(part, {out: decoder.batch(part.column(ids))})

    return df.mapInArrow(run, _schema(df, {out: T.BinaryType()}))
