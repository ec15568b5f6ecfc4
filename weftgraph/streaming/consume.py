"""Consumers of message logs: batches that are acknowledged when their work is done, messages as documents, change events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.logs import LIMIT, Folder, subscribe

#: Messages a poll of a topic's connector and of a pipeline's stream take.
POLL, STREAM_POLL = LIMIT, 100

def lateness(folder: str, ts: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """Work for `consume` with late rows put aside: what is older than the latest time of all earlier batches less the delay goes to
    folder/late, the rest to folder/rows, each under its batch. The latest time is kept with the batch's number, so a batch that
    comes again is split the same way."""
    marks = Folder(folder)

    def work(batch: DataFrame, number: int) -> None:
        before = (marks.get(f"marks/{number - 1}.json") or {}).get("latest") if number else None
        micros = F.unix_micros(ts)
        late = F.lit(False) if before is None else F.coalesce(micros < before - delay_seconds * 1_000_000, F.lit(False))
        batch = batch.persist()
        try:
            batch.filter(~late).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
            latest = batch.agg(F.max(micros)).first()[0]
        finally:
            batch.unpersist()
        marks.put(f"marks/{number}.json", {"latest": max((x for x in (before, latest) if x is not None), default=None)})

    return work


DOCUMENT = "title string, content string, text string, url string, timestamp string, tags array<string>, doc_type string"


def consume(spark: SparkSession, log: str, group: str, work: Callable[[DataFrame, int], None], checkpoint: str, limit: int = POLL, polls: int = 1) -> None:
    """work(batch, number) on all that the group hasn't acknowledged, in batches of `polls` polls of at most `limit` messages;
    returns when there's no more.

    A batch counts as acknowledged after its work has ended. If work raises, or the driver dies, the same batch comes
    again with the same number and the same messages, so work that overwrites by number loses and repeats nothing.
    """
    query = subscribe(spark, log, group, limit, polls=polls).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
        last = query.lastProgress
        if last and (ends := last["sources"][0]["endOffset"]):  # the text of a map
            Folder(log).put(f"groups/{group}.json", json.loads(str(ends).replace("'", '"')))
    finally:
        query.stop()


def into(folder: str) -> Callable[[DataFrame, int], None]:
    """Work for `consume`: each batch as Parquet, under its number."""

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return work


def documents(messages: DataFrame, topic: str) -> DataFrame:
    """Messages (value in JSON) as documents: content falls back on text, then on the whole value."""
    r = F.from_json("value", DOCUMENT)
    return messages.select(r.alias("r"), "value", "partition", "offset").select(
        F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.content", "r.text", "value").alias("content"), F.coalesce("r.url", F.lit("")).alias("url"),
        F.lit(f"kafka:{topic}").alias("source"), F.coalesce("r.timestamp", F.lit("")).alias("published_at"),
        F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("r.doc_type", F.lit("event")).alias("doc_type"), "partition", "offset",
    )


CHANGE = "ns string, op string, nid string, lbl string, aid string, ts string"


def change_messages(rows: DataFrame, namespace: str, op: str, node: str, label: str, agent: str, ts: str) -> DataFrame:
    """Change events as messages, keyed by node so that a node's changes stay in order."""
    event = F.to_json(F.struct(F.lit(namespace).alias("ns"), F.expr(op).alias("op"), F.expr(node).cast("string").alias("nid"), F.lit(label).alias("lbl"), F.lit(agent).alias("aid"), F.col(ts).cast("string").alias("ts")))
    return rows.select(F.expr(node).cast("string").alias("key"), event.alias("value"), F.lit(None).cast("map<string,string>").alias("headers"), F.col(ts).cast("timestamp").alias("timestamp"))


def change_events(messages: DataFrame, namespace: str, operations: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Change events of a namespace, of some operations and labels."""
    out = messages.select(F.from_json("value", CHANGE).alias("r"), "partition", "offset").select("r.*", "partition", "offset").filter(F.col("ns") == namespace)
    out = out.filter(F.col("op").isin(operations)) if operations else out
    return out.filter(F.col("lbl").isin(labels)) if labels else out


def publish_stream(messages: DataFrame, log: str, partitions: int, checkpoint: str, writer: str) -> None:
    """A stream of messages to its present end into a log; a batch that is repeated is published once."""
    from weftgraph.sources.logs import MessageLog

    messages.sparkSession.dataSource.register(MessageLog)
    query = messages.writeStream.format("messagelog").option("path", log).option("partitions", partitions).option("writer", writer)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
