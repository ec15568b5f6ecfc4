"""Schedules over the event table: what is due, when next, and what was missed."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.functions import cron
from weftgraph.session import table

CATALOG = Catalog()
q = CATALOG.add
WORKING = "*/15 9-17 * * 0-4"
WORKING_SQL = "i AS (SELECT * FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', INTERVAL 15 MINUTE) t(due) WHERE hour(due) BETWEEN 9 AND 17 AND isodow(due) <= 5)"


@q("schedule_next", f"WITH {WORKING_SQL} SELECT event_id, strftime(i.due, '%Y-%m-%d %H:%M') AS next_due, hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5 AND minute(ts) % 15 = 0 AS due FROM events ASOF JOIN i ON events.ts < i.due", "E27")
def schedule_next(spark, d):
    """For each event whether its minute is one of a schedule's, and the schedule's next instant."""
    s = cron.Schedule.read(WORKING)
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(s.next_after(ts), "yyyy-MM-dd HH:mm").alias("next_due"), s.matches(ts).alias("due"))


@q("schedule_interval", "SELECT user_id, count(*) AS runs FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NULL OR ts >= last + INTERVAL 6 HOUR GROUP BY 1", "E27")
def schedule_interval(spark, d):
    """Events of a user that come six hours or more after the one before."""
    from pyspark.sql import Window as W

    ts = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").select("user_id", ts.alias("ts"), F.lag(ts).over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("last"))
    return rows.filter(cron.Schedule.read("6h").due(F.col("ts"), F.col("last"))).groupBy("user_id").agg(F.count("*").alias("runs"))



@q("schedule_missed", "WITH i AS (SELECT * FROM (SELECT 'click' AS name, due, due + INTERVAL 10 MINUTE AS following FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28 23:50', INTERVAL 10 MINUTE) t(due) UNION ALL SELECT 'error', due, due + INTERVAL 1 HOUR FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28 23:00', INTERVAL 1 HOUR) t(due))) SELECT name, strftime(due, '%Y-%m-%d %H:%M') AS due FROM i WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = name AND e.ts >= due AND (following >= TIMESTAMP '2024-01-29' OR e.ts < following))", "E27 X15")
def schedule_missed(spark, d):
    """Instants of two schedules, by type of event, to which no event came before the next one."""
    due = cron.instants(spark, {"click": "*/10 * * * *", "error": "@hourly"}, "2024-01-02 00:00:00", "2024-01-29 00:00:00")
    runs = table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("at"))
    return cron.missed(due, runs).select("name", F.date_format("due", "yyyy-MM-dd HH:mm").alias("due"))
