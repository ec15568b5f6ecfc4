"""Media columns: payloads to FLAC and back, as DataFrame operators.

Defined results: a null payload or stream gives null; rows, order and other columns are kept, and a column
that has the name of an output is replaced. A damaged stream fails the task. No shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm import flac

#: Bytes of input that are handled together; a longer value is handled alone, its frames in turns.
BYTES = 1_500_000


def _batches(batch: pa.RecordBatch, column: str):
    """Slices of about BYTES in the column."""
    a = size = 0
    for k, v in enumerate(batch.column(column)):
        size += len(v.as_buffer() or b"") if v.is_valid else 0
        if size >= BYTES:
            yield batch.slice(a, k + 1 - a)
            a, size = k + 1, 0
    if a < batch.num_rows:
        yield batch.slice(a)


def _mapped(df: DataFrame, column: str, outs: list[tuple[str, T.DataType, pa.DataType]], work) -> DataFrame:
    names = [o[0] for o in outs]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, kind) for n, kind, _ in outs])

    def run(batches):
        for batch in batches:
            for part in _batches(batch, column):
                values = part.column(column).to_pylist()
                some = [bytes(v) for v in values if v is not None]
                found = iter(work(some) if some else [])
                rows = [None if v is None else next(found) for v in values]
                columns = [pa.array([None if r is None else r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(outs)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *names])

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Adds the FLAC stream of each payload."""
    return _mapped(df, payload, [(media, T.BinaryType(), pa.binary())], lambda v: [(s,) for s in flac.encode(v)])


def read_back(df: DataFrame, media: str = "media", pcm: str = "pcm", blocks: str = "blocks") -> DataFrame:
    """Adds the samples and the first sample of each block, at which reading can begin."""
    outs = [(pcm, T.BinaryType(), pa.binary()), (blocks, T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    return _mapped(df, media, outs, flac.decode)


def features(df: DataFrame, pcm: str = "pcm", out: str = "feature") -> DataFrame:
    """Adds sums of the samples, of their squares, and zero crossings, as whole numbers in a string."""
    import numpy as np

    def work(values):
        for v in values:
            x = np.frombuffer(v, np.uint8).astype(np.int64) - 128
            yield (f"sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))};peak={np.abs(x).max(initial=0)}",)

    return _mapped(df, pcm, [(out, T.StringType(), pa.string())], work)
