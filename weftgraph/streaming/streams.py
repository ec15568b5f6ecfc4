"""Structured Streaming forms of the windowed, deduplicating and joining operators.

Each takes and gives a DataFrame that may be a stream; delay is the watermark, behind which rows are late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A watched directory as a stream."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def kafka_options(servers: str, topics: str, per_trigger: int = 50, starting: str = "latest", group: str | None = None, pattern: bool = False) -> dict[str, str]:
    """What Spark's Kafka source is told: topics (a list, or a pattern), messages a batch, where to start, whose group."""
    named = {"kafka.bootstrap.servers": servers, "subscribePattern" if pattern else "subscribe": topics, "maxOffsetsPerTrigger": str(per_trigger), "startingOffsets": starting}
    return named | ({"kafka.group.id": group} if group else {})


def kafka(spark: SparkSession, servers: str, topics: str, per_trigger: int = 50, **how) -> DataFrame:
    """Messages of topics; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topics, per_trigger, **how)).load()


def tumbling(df: DataFrame, ts: str, length: str, delay: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.window(ts, length), *by).agg(*aggregates)


def sliding(df: DataFrame, ts: str, length: str, slide: str, delay: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.window(ts, length, slide), *by).agg(*aggregates)


def sessions(df: DataFrame, ts: str, gap: str, delay: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(*aggregates)


def deduplicated(df: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def aligned(left: DataFrame, right: DataFrame, lt: str, rt: str, within: str, delay: str, on: str) -> DataFrame:
    """Pairs of two streams with equal `on` whose times differ by at most `within`."""
    a, b = left.withWatermark(lt, delay), right.withWatermark(rt, delay).withColumnRenamed(on, "_on")
    near = f"{rt} BETWEEN {lt} - INTERVAL {within} AND {lt} + INTERVAL {within}"
    return a.join(b, F.expr(f"{on} = _on AND {near}")).drop("_on")


def changes(df: DataFrame, operations: list[str], labels: list[str] | None = None) -> DataFrame:
    """Of change events the operations (and labels) that a stream emits on."""
    out = df.filter(F.col("operation").isin(operations))
    return out.filter(F.col("label").isin(labels)) if labels else out


def latest_state(df: DataFrame, key: str, value: str, ts: str, ttl: str, delay: str) -> DataFrame:
    """(key, value, since): the last value of each key, gone after ttl without news: a session window's last row."""
    last = F.max_by(value, ts).alias(value)
    return sessions(df, ts, ttl, delay, [key], [last]).select(key, value, F.col("session_window.end").alias("expires"))


def escalations(df: DataFrame, key: str, ts: str, length: str, least: int, delay: str) -> DataFrame:
    """(key, window, n) where an alert comes at least `least` times in a window."""
    return tumbling(df, ts, length, delay, [key], [F.count("*").alias("n")]).filter(F.col("n") >= least)


def published(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that there is now to Parquet, exactly once by the checkpoint; returns the ended query."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(df: DataFrame, work, checkpoint: str):
    """work(batch, number) on every micro-batch, at least once; returns the ended query."""
    query = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_table(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end into Parquet in a shared folder and gives what it wrote: in complete mode the last
    batch, which holds all, else all batches. A batch that is run again overwrites itself, so nothing counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    started = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    started.awaitTermination()
    rows = df.sparkSession.read.schema(df.schema.add("batch", "long")).parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("last"))
        rows = rows.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")  # one row
    return rows.drop("batch")
