"""Schedules against fields compared one by one, over a year of instants."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import cron
from weftgraph.lang import Session
from weftgraph.operators.graph import PropertyGraph


def takes(text, v):
    for token in text.split(","):
        span, _, step = token.partition("/")
        low, _, high = span.partition("-")
        if span == "*" and (not step or v % int(step) == 0):
            return True
        if high and int(low) <= v <= int(high) and (v - int(low)) % int(step or 1) == 0:
            return True
        if not high and not step and span != "*" and int(span) == v:
            return True
    return False


def plain(text, at):
    return all(takes(f, v) for f, v in zip(text.split(), (at.minute, at.hour, at.day, at.month, at.weekday())))


TEXTS = ["*/15 9-17 * * 0-4", "0 0 29 2 *", "30 6 1,15 * *", "5-50/7 */5 * 1-3,12 *", "0 12 * * 6", "59 23 31 12 *", "* * * * *", "0 0 30 2 *"]


def test_a_year_of_instants(spark):
    rng = random.Random(2)
    at = [datetime(2023, 6, 1) + timedelta(minutes=rng.randrange(366 * 1440), seconds=rng.randrange(60)) for _ in range(30)]
    at += [datetime(2024, 2, 28, 23, 59), datetime(2024, 2, 29), datetime(2023, 12, 31, 23, 59), datetime(2023, 12, 31, 23, 58, 59)]
    df = spark.createDataFrame([(t,) for t in at], "t timestamp")
    read = {text: cron.Schedule.read(text) for text in TEXTS}
    rows = df.select("t", *[s.matches(F.col("t")).alias(f"m{k}") for k, s in enumerate(read.values())], *[s.next_after(F.col("t")).alias(f"n{k}") for k, s in enumerate(read.values())]).collect()
    for r in rows:
        for k, (text, s) in enumerate(read.items()):
            assert r[f"m{k}"] == plain(text, r.t) == s.fits(r.t), (text, r.t)
            following = r[f"n{k}"]
            if text == "0 0 30 2 *":
                assert following is None
            elif text in ("0 0 29 2 *", "59 23 31 12 *"):
                assert following > r.t and plain(text, following) and following - r.t < timedelta(days=1462)
            else:
                step = r.t.replace(second=0) + timedelta(minutes=1)
                while not plain(text, step):
                    step += timedelta(minutes=1)
                assert following == step, (text, r.t)


def test_intervals_and_shortcuts(spark):
    assert cron.Schedule.read("30m").every == 1800 and cron.Schedule.read("6h").every == 21600
    assert cron.Schedule.read("daily") == cron.Schedule.read("0 0 * * *") and cron.Schedule.read("a-b x * * *").fields[:2] == (0, 0)
    with pytest.raises(ValueError):
        cron.Schedule.read("* * *")
    t = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(t, None), (t, t - timedelta(seconds=30)), (t, t - timedelta(minutes=30)), (t, t - timedelta(minutes=29, seconds=59))], "t timestamp, last timestamp")
    due = lambda text: [r[0] for r in df.select(cron.Schedule.read(text).due(F.col("t"), F.col("last"))).collect()]
    assert due("30m") == [True, False, True, False] and due("0 12 * * *") == [True, False, True, True] and due("1 12 * * *") == [False] * 4


def test_instants_drive_refreshes(spark):
    due = cron.instants(spark, {"a": "*/10 * * * *", "b": "0 0 1 1 *"}, "2024-01-01 00:00:00", "2024-01-01 01:00:00").orderBy("name", "due").collect()
    assert [(r.name, r.due.minute) for r in due] == [("a", m) for m in range(0, 60, 10)] + [("b", 0)]
    runs = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 5)), ("a", datetime(2024, 1, 1, 0, 30)), ("b", datetime(2024, 1, 3))], "name string, at timestamp")
    left = cron.missed(cron.instants(spark, {"a": "*/10 * * * *", "b": "0 0 1 1 *"}, "2024-01-01 00:00:00", "2024-01-01 01:00:00"), runs)
    assert sorted((r.name, r.due.minute) for r in left.collect()) == [("a", 10), ("a", 20), ("a", 40), ("a", 50)]
    s = Session(spark, PropertyGraph().with_nodes("P", spark.createDataFrame([("1", "n", 1)], "id string, name string, g int")))
    s.run("CREATE MATERIALIZED VIEW v AS SELECT g, COUNT(*) AS n FROM P GROUP BY g REFRESH EVERY 20 MINUTES")
    seen = []
    for r in due[:6]:
        s.run(f"CREATE NODE P {{id: 'x{r.due.minute}', name: 'n', g: 1}}")
        s.tick(r.due)
        seen.append(s.run("SELECT n FROM v").first().n)
    assert seen == [1, 1, 4, 4, 6, 6]
