"""Periodic runs of words by bit-parallel lags.

The distinct words of a text are numbered, and bit plane k is a big integer whose bit i is bit k of the number of
word i. For a lag q the planes are XORed with themselves shifted by q and the results ORed: a zero at i says that
words i and i + q are the same. A run of period q and of length l is a stretch of l - q such zeros, and ANDs of the
zeros with themselves, shifted by doubling steps, leave only stretches that are long enough. One plane after the
other is taken in, and a lag is given up as soon as nothing is left, which for most lags is after one or two planes.

A run is a stretch of consecutive words of smallest period q, of at least `least` words and `times` periods, that no
neighbouring word extends at that period. A place whose `times` periods of length q all lie in a run of a smaller
period belongs to a stretch that has that period too; such places are cleared. What is left are runs: a shorter
period of one would divide q, and its run, being as long, was found before.

Defined results: a null or empty text has no words and no runs; of runs of equal length / period the one that starts
first is the best, then the one of the smaller period; repeated rows give repeated rows; an empty table gives none; of
a table's other columns the named ones are carried along, whatever their names. A very long text is worked on alone:
memory grows with its length, time with the square of its number of words over 64 (600,000 words: under a minute).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.shared import pieces

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: start, length and period of a run, in words.
Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: bytes.split() cuts at \\x20 and \\x09 to \\x0D, no others."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _planes(words: list[bytes]) -> list[int]:
    """Bit planes of the words' numbers, which count distinct words as they appear."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = max(1, (len(known) - 1).bit_length())
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(width)]


def _long_enough(same: int, length: int) -> int:
    """Places where a stretch of set bits starts that goes on for `length` bits."""
    got = 1
    while same and got < length:
        step = min(got, length - got)
        same &= same >> step
        got += step
    return same


def _stretches(starts: int, length: int) -> list[tuple[int, int]]:
    """(first, end) of the maximal stretches, of which `starts` has all places with `length` bits to come."""
    bits = np.frombuffer(starts.to_bytes(starts.bit_length() // 8 + 1, "little"), np.uint8)
    flags = np.diff(np.unpackbits(bits, bitorder="little").astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)
    return list(zip(first.tolist(), (last + (length - 1)).tolist(), strict=True))


def runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs by start, then period."""
    n, found = len(words), []
    if n < least:
        return found
    planes = _planes(words)
    full = (1 << n) - 1
    for q in range(1, n // times + 1):
        full >>= 1
        needed = max(least, times * q) - q
        if needed > n - q:
            continue
        miss = 0
        for plane in planes:
            miss |= plane ^ plane >> q
            left = _long_enough(full ^ (miss & full), needed)
            if not left:
                break
        else:
            for start, size, _ in found:
                if size >= needed + q:  # what lies in a run of a smaller period
                    left &= ~((1 << (size - needed - q + 1)) - 1 << start)
            found += [(first, end + q - first, q) for first, end in _stretches(left, needed)] if left else []
    found.sort()
    return found


def best(found: list[Run]) -> Run | None:
    """The run of the greatest exact length / period."""
    top = None
    for run in found:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rewrite: Callable[[tuple, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The key columns, `runs` (all, by start and period), `best` (null without runs) and `collapsed` of each text.

    rewrite(keys, words) may replace the words before they are looked at. No shuffle.
    """
    kind = T.StructType([*(docs.schema[k] for k in keys), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.BinaryType())])
    arrow = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                lists, tops, texts = [], [], []
                named = [part.column(k) for k in keys]
                for *key, value in zip(*(c.to_pylist() for c in named), part.column(text).to_pylist(), strict=True):
                    words = words_of(value)
                    if rewrite:
                        words = rewrite(tuple(key), words)
                    found = runs(words, least, times)
                    lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    top = best(found)
                    tops.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                    texts.append(collapsed(words, found) if found else b" ".join(words))
                columns = [*named, pa.array(lists, pa.list_(arrow)), pa.array(tops, arrow), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return docs.select(*keys, text).mapInArrow(run, kind)
