"""Message logs in a shared folder: keyed messages in partitions, each message with an offset, read by consumer groups.

    segments/<uuid>.parquet      messages of one partition: key, value, headers, timestamp
    commits/<n>.json             one a publication: its segments with their offsets, and where all partitions end then
    groups/<group>.json          the offsets up to which a group has acknowledged

A publication counts from the moment its commit file is there, so a lost task or driver leaves nothing half published; tasks
that run twice leave a segment that no commit names. One publisher at a time: the commit number must not be there yet.

    spark.dataSource.register(MessageLog)
    df.write.format("messagelog").option("path", folder).option("partitions", 4).mode("append").save()
    spark.readStream.format("messagelog").option("path", folder).option("group", "g").option("limit", 50).load()

A stream polls at most `limit` messages at a time (50 as it comes), from where the checkpoint or else the group left off; a group
that never read starts at `startingOffsets` (earliest or latest). A batch has `polls` of them (one as it comes), dealt evenly over
the partitions and run side by side by segment, so a long backlog needs few batches. When a batch has ended its offsets are
acknowledged for the group. Batches that were planned are planned again after a restart, with the same offsets.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

LIMIT = 50
#: Messages that a task of a publication keeps in memory for a partition before it writes a segment.
SEGMENT = 50_000
SCHEMA = "key string, value string, headers map<string,string>, timestamp timestamp, partition int, offset long"
MESSAGE = pa.schema([("key", pa.string()), ("value", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("timestamp", pa.timestamp("us", "UTC"))])


class Folder:
    """A folder on any store that pyarrow can reach, mounted or remote."""

    def __init__(self, url: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(url if "://" in url else f"file://{os.path.abspath(url)}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        return sorted(f.base_name for f in self.files.get_file_info(fs.FileSelector(self.path(folder), allow_not_found=True)) if f.base_name.endswith(".json"))

    def get(self, name: str) -> dict | None:
        try:
            with self.files.open_input_stream(self.path(name)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, name: str, data: dict, replace: bool = True) -> None:
        """Whole or not at all."""
        from pyarrow import fs

        target = self.path(name)
        self.files.create_dir(os.path.dirname(target), recursive=True)
        if not replace and self.files.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(target)
        part = f"{target}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(data).encode())
        self.files.move(part, target)


@dataclass
class Segment:
    partition: int
    first: int
    count: int
    file: str


class Log:
    """The commits of a log; what was read once isn't read again."""

    def __init__(self, url: str):
        self.folder, self.commits = Folder(url), {}

    def ends(self) -> dict[str, int]:
        """The offset behind the last message of each partition."""
        names = self.folder.names("commits")
        return self._commit(names[-1])["ends"] if names else {}

    def _commit(self, name: str) -> dict:
        if name not in self.commits:
            self.commits[name] = self.folder.get(f"commits/{name}")
        return self.commits[name]

    def segments(self, start: dict[str, int], end: dict[str, int]) -> Iterator[Segment]:
        """The segments that hold messages between two offsets, from the newest commit back to the one that ends at start."""
        for name in reversed(self.folder.names("commits")):
            commit = self._commit(name)
            if all(commit["ends"].get(p, 0) <= start.get(p, 0) for p in end):
                break
            for s in commit["segments"]:
                p = str(s["partition"])
                if s["first"] < end.get(p, 0) and s["first"] + s["count"] > start.get(p, 0):
                    yield Segment(**s)

    def commit(self, written: list[dict], partitions: int, by: list | None = None) -> None:
        """Gives the segments their offsets, in the order of tasks, and publishes them. `by` names a writer and its batch: a
        batch that a writer has published already isn't published again."""
        names = self.folder.names("commits")
        ends = dict(self._commit(names[-1])["ends"]) if names else {}
        writers = dict(self._commit(names[-1]).get("writers", {})) if names else {}
        if by:
            if writers.get(by[0], -1) >= by[1]:
                return
            writers[by[0]] = by[1]
        ends = {str(p): 0 for p in range(partitions)} | ends
        segments = []
        for one in written:
            p = str(one["partition"])
            segments.append({"partition": one["partition"], "first": ends[p], "count": one["count"], "file": one["file"]})
            ends[p] += one["count"]
        number = int(names[-1].removesuffix(".json")) + 1 if names else 0
        self.folder.put(f"commits/{number:020d}.json", {"segments": segments, "ends": ends, "writers": writers}, replace=False)


@dataclass
class Range(InputPartition):
    """Messages of one segment, from..to counted within it."""

    file: str
    partition: int
    first: int
    begin: int
    end: int


def ranges(log: Log, start: dict[str, int], end: dict[str, int]) -> list[Range]:
    found = []
    for s in log.segments(start, end):
        p = str(s.partition)
        found.append(Range(s.file, s.partition, s.first, max(start.get(p, 0) - s.first, 0), min(end[p] - s.first, s.count)))
    return sorted(found, key=lambda r: (r.partition, r.first))


def messages(url: str, part: Range, limit: int = 10_000) -> Iterator[pa.RecordBatch]:
    """At most `limit` messages at a time."""
    import pyarrow.parquet as pq

    folder, at = Folder(url), 0
    with folder.files.open_input_file(folder.path(f"segments/{part.file}")) as f:
        for batch in pq.ParquetFile(f).iter_batches(min(limit, 10_000)):
            a, b = max(part.begin - at, 0), min(part.end - at, batch.num_rows)
            if a < b:
                some = batch.slice(a, b - a)
                numbers = range(part.first + at + a, part.first + at + b)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([part.partition] * (b - a), pa.int32()), pa.array(numbers, pa.int64())], names=[*MESSAGE.names, "partition", "offset"])
            at += batch.num_rows
            if at >= part.end:
                return


@dataclass
class Written(WriterCommitMessage):
    segments: list[dict]


def write_segments(url: str, partitions: int, rows: Iterator, size: int = SEGMENT) -> Written:
    """A task's rows into segments, by the CRC-32 of the key; rows without a key go to partition 0."""
    import pyarrow.parquet as pq

    folder, held, done = Folder(url), {}, []

    def flush(p: int) -> None:
        columns = list(zip(*held.pop(p), strict=True))
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, MESSAGE, strict=True)], schema=MESSAGE)
        name = f"{uuid.uuid4().hex}.parquet"
        folder.files.create_dir(folder.path("segments"), recursive=True)
        with folder.files.open_output_stream(folder.path(f"segments/{name}")) as f:
            pq.write_table(table, f)
        done.append({"partition": p, "count": table.num_rows, "file": name})

    for row in rows:
        key = row["key"]
        p = 0 if key is None else crc32(key.encode()) % partitions
        held.setdefault(p, []).append((key, row["value"], list((row["headers"] or {}).items()), row["timestamp"]))
        if len(held[p]) >= size:
            flush(p)
    for p in list(held):
        flush(p)
    return Written(done)


class Reader(DataSourceReader):
    """All messages that are there when it is planned."""

    def __init__(self, options: dict):
        self.url = options["path"]

    def partitions(self) -> list[Range]:
        log = Log(self.url)
        return ranges(log, {}, log.ends()) or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return messages(self.url, partition) if partition.file else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.limit, self.polls = options["path"], int(options.get("limit", LIMIT)), int(options.get("polls", 1))
        self.group, self.latest = options.get("group"), options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"
        self.log, self.at = Log(self.url), None

    def initialOffset(self) -> dict:
        known = self.group and self.log.folder.get(f"groups/{self.group}.json")
        if known:
            return known
        ends = self.log.ends()
        return ends if self.latest else dict.fromkeys(ends, 0)

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        self.at = advanced(self.at, self.log.ends(), self.limit * self.polls)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.at is None:  # a batch from before the restart
            self.at = end
        return ranges(self.log, start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return messages(self.url, partition, self.limit)

    def commit(self, end: dict) -> None:
        if self.group:
            self.log.folder.put(f"groups/{self.group}.json", end)


def advanced(at: dict[str, int], ends: dict[str, int], limit: int) -> dict[str, int]:
    """Offsets at most `limit` messages further on: equal shares, and what a partition leaves goes to the others."""
    new, left = {p: at.get(p, 0) for p in ends}, limit
    for k, p in enumerate(sorted(ends, key=lambda p: (ends[p] - new[p], int(p)))):
        take = min(ends[p] - new[p], -(-left // (len(ends) - k)))
        new[p] += take
        left -= take
    return new


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.url, self.parts = options["path"], int(options.get("partitions", 1))

    def write(self, iterator: Iterator) -> Written:
        return write_segments(self.url, self.parts, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        Log(self.url).commit([s for m in messages if m for s in m.segments], self.parts)

    def abort(self, messages: list[Written | None]) -> None:
        pass  # segments without a commit aren't read


class StreamWriter(DataSourceStreamWriter):
    """A batch that is written again, after a restart, isn't published twice: option `writer` names who writes."""

    def __init__(self, options: dict):
        self.url, self.parts, self.name = options["path"], int(options.get("partitions", 1)), options.get("writer", "stream")

    def write(self, iterator: Iterator) -> Written:
        return write_segments(self.url, self.parts, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        Log(self.url).commit([s for m in messages if m for s in m.segments], self.parts, [self.name, batchId])

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        pass


class MessageLog(DataSource):
    """The log as a source and sink of Spark, for batches and streams."""

    @classmethod
    def name(cls) -> str:
        return "messagelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def as_messages(df: DataFrame, key: str, timestamp: str | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """Rows as messages: the key as text, the whole row as JSON."""
    named = F.create_map(*[F.lit(x) for pair in headers.items() for x in pair]) if headers else F.lit(None)
    at = F.col(timestamp) if timestamp else F.lit(None)
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), named.cast("map<string,string>").alias("headers"), at.cast("timestamp").alias("timestamp"))


def publish(df: DataFrame, path: str, partitions: int) -> None:
    """Appends messages (key, value, headers, timestamp) to a log, and makes it if it isn't there."""
    df.sparkSession.dataSource.register(MessageLog)
    df.select("key", "value", "headers", "timestamp").write.format("messagelog").option("path", path).option("partitions", partitions).mode("append").save()


def subscribe(spark, path: str, group: str | None = None, limit: int = LIMIT, starting: str = "earliest", polls: int = 1) -> DataFrame:
    """The log as a stream of `polls` polls a batch, each of at most `limit` messages."""
    spark.dataSource.register(MessageLog)
    reader = spark.readStream.format("messagelog").option("path", path).option("limit", limit).option("polls", polls).option("startingOffsets", starting)
    return (reader.option("group", group) if group else reader).load()
