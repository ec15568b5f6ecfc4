"""The folder that driver and executors share, and small helpers around it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (or list elements) of an Arrow batch that are worked on together; a longer value is worked on alone.
ROWS, BYTES = 1000, 4 << 20

#: Words of the corpus operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(8)
def _stand_in(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="weftgraph-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, removed when the JVM ends.

    Only where that setting is absent (tests in local mode) a temporary folder stands in for it, one an application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _stand_in(spark.sparkContext.applicationId)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(url: str) -> str | None:
    """The mounted path behind a file: URL; None for any other store."""
    parts = urlparse(url)
    return parts.path if parts.scheme in ("", "file") else None


def store(url: str):
    """(filesystem, path) for Python workers, local or remote."""
    from pyarrow import fs

    here = local_path(url)
    if here is not None:
        return fs.LocalFileSystem(), here
    return fs.FileSystem.from_uri(url)


def put(url: str, data: bytes) -> None:
    """Write whole or not at all, so that a repeated task can't leave half a file."""
    files, path = store(url)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def get(url: str) -> bytes:
    files, path = store(url)
    with files.open_input_stream(path) as f:
        return f.read()


def words(col):
    """Array of the words of a text; null counts as the empty text."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD), F.lit(0))


def pieces(batch: pa.RecordBatch, column: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most so many rows and, but for a longer value alone, so much of a column."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] + size, "right")) - 1
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def strings(array: pa.Array) -> list:
    """The values of a string array; the way over NumPy takes a tenth of the time of to_pylist()."""
    return array.to_numpy(zero_copy_only=False).tolist()
