"""Message logs, pages of an interface, and keyed state with expiry, each run to its end and compared with the whole table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.lang import Session
from weftgraph.operators.graph import graph_of_tables
from weftgraph.plans.graphs import scratch, stream
from weftgraph.session import stream_of, table
from weftgraph.sources import logs, pages
from weftgraph.streaming import consume as C
from weftgraph.streaming import state, streams

CATALOG = Catalog()
q = CATALOG.add
#: Messages that the queries take at a time; the library's own limits are 50 and 100.
LIMIT = 5000
#: Polls that a batch runs side by side, so that a backlog of millions isn't thousands of batches.
POLLS = 256
STAMP, STAMP_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


def consumed(spark, log: str, group: str, schema: str):
    """All messages that a group gets, batch by batch."""
    folder = scratch(spark)
    C.consume(spark, log, group, C.into(f"{folder}/rows"), f"{folder}/checkpoint", LIMIT, POLLS)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows")


@q("log_consume", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events", "S21 X1")
def log_consume(spark, d):
    """Events published as a log of four partitions, consumed by a group in acknowledged batches."""
    log = scratch(spark)
    logs.publish(logs.as_messages(table(spark, d, "events"), "user_id", "ts", {"table": "events"}), log, 4)
    rows = consumed(spark, log, "readers", logs.SCHEMA)
    r = F.from_json("value", "event_id long, user_id long, event_type string, value double").alias("r")
    return rows.select(r).select("r.event_id", "r.user_id", "r.event_type", F.round("r.value", 6).alias("value"))


@q("log_offsets", "SELECT DISTINCT count(*) OVER () AS messages, count(DISTINCT user_id) OVER () AS keys, 1 AS partitions_of_a_key, 0 AS gaps FROM events", "S21")
def log_offsets(spark, d):
    """A key's messages are in one partition, and the offsets of a partition have no gaps."""
    log = scratch(spark)
    logs.publish(logs.as_messages(table(spark, d, "events"), "user_id", "ts"), log, 4)
    rows = spark.read.format("messagelog").option("path", log).load()
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("partition").alias("p"))
    gaps = rows.groupBy("partition").agg((F.max("offset") + 1 - F.countDistinct("offset")).alias("g")).agg(F.sum("g").alias("gaps"))
    return keys.agg(F.sum("n").alias("messages"), F.count("*").alias("keys"), F.max("p").alias("partitions_of_a_key")).crossJoin(gaps)


@q("log_documents", "SELECT 'page ' || page_id AS title, html AS content, url, 'kafka:pages' AS source, 'event' AS doc_type FROM pages", "S20 S22")
def log_documents(spark, d):
    """Pages through a topic into documents: what has no content of its own has its text."""
    log = scratch(spark)
    rows = table(spark, d, "pages").select(F.concat(F.lit("page "), "page_id").alias("title"), F.col("html").alias("text"), "url")
    logs.publish(logs.as_messages(rows, "url"), log, 2)
    return C.documents(consumed(spark, log, "pages", logs.SCHEMA), "pages").select("title", "content", "url", "source", "doc_type")


CHANGES = "SELECT CASE o_orderstatus WHEN 'O' THEN 'INSERT' WHEN 'F' THEN 'UPDATE' ELSE 'DELETE' END AS op, o_orderkey::VARCHAR AS nid FROM orders"


@q("change_groups", f"SELECT 'writes' AS grp, op, count(*) AS n, count(DISTINCT nid) AS nodes FROM ({CHANGES}) WHERE op <> 'DELETE' GROUP BY op UNION ALL SELECT 'deletes', op, count(*), count(DISTINCT nid) FROM ({CHANGES}) WHERE op = 'DELETE' GROUP BY op", "X3 X4 X5")
def change_groups(spark, d):
    """Orders as a stream of change events into a log, and two groups that read it independently for their operations."""
    folder = scratch(spark)
    orders = stream_of(spark, d, "orders")
    op = "CASE o_orderstatus WHEN 'O' THEN 'INSERT' WHEN 'F' THEN 'UPDATE' ELSE 'DELETE' END"
    messages = C.change_messages(orders, "shop", op, "o_orderkey", "Order", "loader", "o_orderdate")
    C.publish_stream(messages, f"{folder}/log", 3, f"{folder}/publisher", "orders")
    out = None
    for group, operations in (("writes", ["INSERT", "UPDATE"]), ("deletes", ["DELETE"])):
        some = C.change_events(consumed(spark, f"{folder}/log", group, logs.SCHEMA), "shop", operations, ["Order"])
        one = some.groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("nid").alias("nodes")).select(F.lit(group).alias("grp"), "op", "n", "nodes")
        out = one if out is None else out.unionByName(one)
    return out


LATE = "WITH b AS (SELECT event_id, ts, event_id % 3 AS batch FROM events), m AS (SELECT batch, max(ts) AS latest FROM b GROUP BY 1) SELECT event_id, batch, coalesce(ts < (SELECT max(latest) FROM m WHERE m.batch < b.batch) - INTERVAL 20 DAY, false) AS late FROM b"


@q("late_rows", LATE, "X13")
def late_rows(spark, d):
    """Three publications, a batch each; rows twenty days behind what came in earlier batches are put aside."""
    folder = scratch(spark)
    events = table(spark, d, "events")
    for k in range(3):
        logs.publish(logs.as_messages(events.filter(F.col("event_id") % 3 == k), "user_id", "ts"), f"{folder}/log", 2)
        C.consume(spark, f"{folder}/log", "g", C.lateness(folder, "timestamp", 20 * 86400), f"{folder}/checkpoint", 1 << 40)
    read = lambda name: spark.read.schema(f"{logs.SCHEMA}, batch long").parquet(f"{folder}/{name}")
    both = read("rows").withColumn("late", F.lit(False)).unionByName(read("late").withColumn("late", F.lit(True)))
    return both.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "batch", "late")


@q("load_api", "SELECT c_custkey, c_name, c_nationkey FROM customer", "S12")
def load_api(spark, d):
    """Customers as pages with links, a chain for each nation, and read back by following them."""
    folder = scratch(spark)
    chains = pages.write_pages(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), folder, "c_nationkey", ["c_custkey"], 50)
    starts = ", ".join(f"\"{folder}/{r.chain}-0.json\"" for r in chains.select("chain").collect())  # one for each nation
    session = Session(spark, graph_of_tables(spark, d))
    schema = "c_custkey long, c_name string, c_nationkey int"
    return session.run(f"LOAD API '[{starts}]' INTO c WITH METHOD = 'GET', PAGINATION = TRUE, ITEMS = 'data.items', NEXT = 'links.next', SCHEMA = '{schema}'; SELECT c_custkey, c_name, c_nationkey FROM c")


# -- keyed state ---------------------------------------------------------------------------------------------------


def ended(spark, rows):
    with state.rocksdb(spark):
        return streams.to_table(rows, scratch(spark), "append")


def stamped(df, *columns):
    return df.withColumns({c: F.date_format(c, STAMP) for c in columns})


SESSIONS = "WITH t AS ({rows}), p AS (SELECT *, lag(ts) OVER w AS before FROM t WINDOW w AS (PARTITION BY k ORDER BY ts, v)), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL {ttl} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, v ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT {select} FROM s GROUP BY k, g HAVING max(ts) + INTERVAL {ttl} <= (SELECT date_trunc('milliseconds', max(ts)) FROM t)"
PRESENCE = SESSIONS.format(
    rows="SELECT user_id AS k, ts, event_type AS v FROM events", ttl="6 HOUR",
    select=f"k AS user_id, strftime(min(ts), '{STAMP_SQL}') AS since, strftime(max(ts), '{STAMP_SQL}') AS last, strftime(max(ts) + INTERVAL 6 HOUR, '{STAMP_SQL}') AS expires, count(*) AS sets, arg_max(v, (ts, v)) AS value",
)


@q("presence_expiry", PRESENCE, "X7")
def presence_expiry(spark, d):
    """What each user did last, forgotten six hours later: value state with timers, over the event stream."""
    rows = state.presence(stream(spark, d), "user_id", "event_type", "ts", timedelta(hours=6), "0 seconds")
    return stamped(ended(spark, rows), "since", "last", "expires").withColumnRenamed("key", "user_id")


TURNS = "SELECT conv_id AS k, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn * 40 + (turn // 3) * 600) AS ts, turn AS v, role, text FROM conversations"
ENDS = SESSIONS.format(rows=TURNS, ttl="5 MINUTE", select=f"k AS conv_id, strftime(max(ts) + INTERVAL 5 MINUTE, '{STAMP_SQL}') AS ended, count(*) AS turns, arg_min(role, (ts, v)) AS first_role, arg_max(role, (ts, v)) AS last_role, sum(length(text))::BIGINT AS chars")


@q("conversation_expiry", ENDS, "X8")
def conversation_expiry(spark, d):
    """Conversations with a pause after every third turn end after five minutes at rest: list state of turns."""
    turns = stream_of(spark, d, "conversations")
    seconds = F.col("conv_id") * 60 + F.col("turn") * 40 + F.floor(F.col("turn") / 3) * 600
    turns = turns.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + seconds))
    rows = state.conversation_ends(turns, "conv_id", "turn", "role", "text", "ts", timedelta(minutes=5), "0 seconds")
    return stamped(ended(spark, rows), "ended").withColumnRenamed("key", "conv_id")


ESCALATIONS = f"""WITH RECURSIVE a AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, i, NULL::TIMESTAMP AS started, 0 AS used FROM a WHERE i = 1
UNION ALL SELECT a.user_id, a.i, CASE WHEN a.ts < r.started + INTERVAL 48 HOUR THEN r.started WHEN a.i - 2 > r.used AND a.ts - b.ts <= INTERVAL 24 HOUR THEN a.ts END,
CASE WHEN a.ts < r.started + INTERVAL 48 HOUR OR (a.i - 2 > r.used AND a.ts - b.ts <= INTERVAL 24 HOUR) THEN a.i ELSE r.used END
FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1 LEFT JOIN a b ON b.user_id = a.user_id AND b.i = a.i - 2)
SELECT user_id, strftime(started, '{STAMP_SQL}') AS escalated_at, strftime(started + INTERVAL 48 HOUR, '{STAMP_SQL}') AS deescalate_at, count(*) - 1 AS taken_in
FROM r WHERE started + INTERVAL 48 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE event_type = 'error') GROUP BY user_id, started"""


@q("escalation_expiry", ESCALATIONS, "X16")
def escalation_expiry(spark, d):
    """Three errors of a user within a day escalate for two days, in which further errors are taken in."""
    errors = stream(spark, d).filter("event_type = 'error'")
    rows = state.escalations(errors, "user_id", "event_type", "ts", 3, timedelta(hours=24), timedelta(hours=48), "0 seconds")
    return stamped(ended(spark, rows), "escalated_at", "deescalate_at").withColumnRenamed("key", "user_id")


# -- files whose format isn't told ----------------------------------------------------------------------------------


@q("records_sniffed", "SELECT 'csv' AS format, '' AS record_type, 'name: ' || c_name || '; key: ' || c_custkey AS content FROM customer UNION ALL SELECT 'jsonl', 'Product', 'name: ' || p_name || '; price: ' || p_size || '; sku: ' || p_partkey FROM part UNION ALL SELECT 'json_array', '', 'id: ' || s_suppkey || '; nation: ' || s_nationkey FROM supplier", "S14")
def records_sniffed(spark, d):
    """Three tables written as CSV, JSON lines and JSON arrays into one folder, and read without being told which is which."""
    import pyarrow as pa

    from weftgraph.sources import records

    folder = scratch(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.csv(f"{folder}/a", header=True, sep=";")
    table(spark, d, "part").select(F.col("p_size").cast("string").alias("price"), F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name")).write.json(f"{folder}/b")
    rows = table(spark, d, "supplier").select(F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))).alias("value"))

    def arrays(batches):  # an array for each task's file
        held = [v for b in batches for v in b.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f"[{', '.join(held)}]"])], names=["value"])

    rows.repartition(4).mapInArrow(arrays, "value string").write.text(f"{folder}/c")
    return records.read_records(spark, folder).select("format", "record_type", "content")


@q("load_turtle", "SELECT 'http://g/N' || n_nationkey AS subject, 'name' AS predicate, NULL AS object, n_name AS literal FROM nation UNION ALL SELECT 'http://g/N' || n_nationkey, 'in', 'http://g/R' || n_regionkey, NULL FROM nation UNION ALL SELECT 'http://g/S' || s_suppkey, 'in', 'http://g/N' || s_nationkey, NULL FROM supplier UNION ALL SELECT 'http://g/S' || s_suppkey, 'name', NULL, s_name FROM supplier", "S16")
def load_turtle(spark, d):
    """Nations and suppliers written as Turtle, a file a task with its own prefixes, and read back as triples."""
    import pyarrow as pa

    from weftgraph.sources.turtle import turtle

    folder = scratch(spark)
    nations = table(spark, d, "nation").select(F.concat(F.lit("g:N"), "n_nationkey", F.lit(' v:name "'), "n_name", F.lit('"@en ; v:in g:R'), "n_regionkey", F.lit(" .")).alias("value"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("g:S"), "s_suppkey", F.lit(" v:in g:N"), "s_nationkey", F.lit("; v:name '"), "s_name", F.lit("' .")).alias("value"))

    def with_prefixes(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["@prefix g: <http://g/> .\nPREFIX v: <http://v/>"])], names=["value"])
        for batch in batches:
            yield batch.select(["value"])

    nations.unionByName(suppliers).repartition(4).mapInArrow(with_prefixes, "value string").write.text(folder)
    return turtle(spark, folder).withColumn("predicate", F.substring_index("predicate", "/", -1))
