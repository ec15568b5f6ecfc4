"""Joins, windows, temporal and event analytics, rules and derivations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.catalog import Catalog
from weftgraph.operators import analytics as A
from weftgraph.operators import versions as V
from weftgraph.session import table

CATALOG = Catalog()
q = CATALOG.add
AS_OF = "2024-01-20 00:00:00"
SENTIMENT = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END"
T = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def signals(spark, sf_dir):
    return events(spark, sf_dir).withColumn("sentiment", F.expr(SENTIMENT))


def shown(ts="ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# -- joins --------------------------------------------------------------------------------------------------


@q("semi_join", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "J3 J24")
def semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@q("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", "J15 J19 U3")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@q("left_resolution", "SELECT o_orderkey, coalesce(c_name, 'missing') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey", "J5 J4")
def left_resolution(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("missing")).alias("name"))


@q(
    "full_outer_diff",
    "WITH a AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) "
    "SELECT coalesce(b.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n = b.n AND a.s = b.s THEN 'unchanged' ELSE 'modified' END AS change, coalesce(b.n, 0) - coalesce(a.n, 0) AS n_delta, round(coalesce(b.s, 0) - coalesce(a.s, 0), 2) AS s_delta FROM b FULL JOIN a ON a.k = b.k",
    "J14 E2",
)
def full_outer_diff(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    side = lambda t: o.filter(t).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    out = V.snapshot_diff(side(F.col("o_orderdate") < cut), side(F.col("o_orderdate") >= cut), "k", ["n", "s"])
    return out.withColumn("s_delta", F.round("s_delta", 2))


@q(
    "range_align",
    "SELECT a.event_id AS purchase, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000",
    "J6 J7",
)
def range_align(spark, d):
    e = events(spark, d)
    a = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("ta"))
    b = e.filter("event_type = 'error'").select(F.col("event_id").alias("error"), "user_id", F.col("ts").alias("tb"))
    return A.range_join(a, b, "ta", "tb", 7200, ["user_id"]).select("purchase", "error")


@q(
    "asof_join",
    "SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts",
    "J26",
)
def asof_join(spark, d):
    e = events(spark, d)
    a = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return V.as_of_join(a, b, "user_id", "ts", "ts", "value", "last_value").select("event_id", "last_value")


@q("asof_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", "J25 J26 E8 T10")
def asof_latest(spark, d):
    return V.as_of(table(spark, d, "orders"), "o_custkey", "o_orderdate", F.lit("1997-06-01").cast("timestamp_ntz"), "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@q("self_shared_field", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", "J8 Q10")
def self_shared_field(spark, d):
    return A.shared_field(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@q(
    "cooccurrence_weighted",
    "WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS weight FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 12",
    "J9 J10 E21",
)
def cooccurrence_weighted(spark, d):
    return A.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 12)


@q(
    "fk_edges",
    "SELECT 'nation_' || n_nationkey AS source, 'region_' || r_regionkey AS target FROM nation JOIN region ON lower(trim(n_regionkey::VARCHAR)) = lower(trim(r_regionkey::VARCHAR))",
    "J11 J12 J13",
)
def fk_edges(spark, d):
    key = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, key("n_regionkey") == key("r_regionkey")).select(F.concat(F.lit("nation_"), "n_nationkey").alias("source"), F.concat(F.lit("region_"), "r_regionkey").alias("target"))


DAILY = "SELECT event_type, ts::DATE AS day, count(*)::DOUBLE AS n, sum(value) AS v FROM events GROUP BY 1, 2"


@q(
    "cross_threshold",
    f"WITH d AS ({DAILY}) SELECT a.event_type AS a, b.event_type AS b, round(coalesce(corr(a.n, b.v), 0), 5) AS r FROM d a JOIN d b ON a.day = b.day GROUP BY 1, 2 HAVING abs(coalesce(corr(a.n, b.v), 0)) >= 0.1 AND count(*) >= 3",
    "J20 J22 A23",
)
def cross_threshold(spark, d):
    daily = events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    a, b = daily.select(F.col("event_type").alias("a"), "day", "n"), daily.select(F.col("event_type").alias("b"), "day", "v")
    return a.join(b, "day").groupBy("a", "b").agg(A.pearson("n", "v").alias("r")).filter("abs(r) >= 0.1").withColumn("r", F.round("r", 5))


@q(
    "positional_align",
    "WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT a.user_id, a.n, a.value AS x, b.value AS y FROM a JOIN a b ON b.user_id = a.user_id + 1 AND b.n = a.n",
    "J21",
)
def positional_align(spark, d):
    """Each user's sequence beside that of the next one."""
    own = events(spark, d).select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("n"), F.col("value").alias("x"))
    return own.join(own.select((F.col("user_id") - 1).alias("user_id"), "n", F.col("x").alias("y")), ["user_id", "n"])


@q(
    "federated_union",
    "SELECT c_custkey AS id, 'local' AS origin FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, 'partners' FROM supplier WHERE s_acctbal > 0",
    "J24 U5 Q11 P26",
)
def federated_union(spark, d):
    local = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.lit("Customer").alias("label"))
    shared = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Supplier").alias("label"), F.lit("partners").alias("ns"), F.when(F.col("s_acctbal") > 0, "PUBLIC").otherwise("PRIVATE").alias("visibility"))
    grants = spark.createDataFrame([("partners",)], "ns string")
    return A.granted(local, shared, grants, ["Supplier"]).select("id", "origin")


@q("set_operations", "(SELECT c_nationkey AS k, 'both' AS s FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'one' FROM customer EXCEPT SELECT s_nationkey, 'one' FROM supplier)", "U1 U2 U3 U7")
def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("s", F.lit("both")).unionAll(c.subtract(s).withColumn("s", F.lit("one")))


# -- windows ------------------------------------------------------------------------------------------------


@q("cap_per_label", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 7", "W1 W2")
def cap_per_label(spark, d):
    return A.capped(events(spark, d), "event_type", [F.desc("value"), "event_id"], 7).select("event_type", "event_id", "value")


@q(
    "validity_intervals",
    "SELECT o_custkey, o_orderkey, row_number() OVER w AS version, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, strftime(lead(o_orderdate) OVER w, '%Y-%m-%d') AS valid_to FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "W3 W4 E4",
)
def validity_intervals(spark, d):
    v = V.intervals(V.numbered(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return v.select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), day("valid_from"), day("valid_to"))


@q(
    "version_diff",
    "SELECT o_orderkey, concat_ws(',', CASE WHEN NOT f AND o_orderstatus IS DISTINCT FROM ps THEN 'o_orderstatus' END, CASE WHEN NOT f AND o_orderpriority IS DISTINCT FROM pp THEN 'o_orderpriority' END) AS changed FROM (SELECT *, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp, row_number() OVER w = 1 AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))",
    "W5 E5",
)
def version_diff(spark, d):
    return V.changed_keys(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "changed")


@q("lag_change", "SELECT event_id, previous, CASE WHEN previous IS NULL THEN NULL WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'same' END AS direction FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)", "W10")
def lag_change(spark, d):
    return A.change(events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", "previous", "direction")


@q(
    "streak",
    "WITH d AS (SELECT user_id, ts::DATE AS day, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, sum(CASE WHEN v >= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day DESC) AS broken FROM d) SELECT user_id, sum(CASE WHEN broken = 0 THEN 1 ELSE 0 END)::BIGINT AS streak FROM b GROUP BY 1",
    "W6 W7 Q4",
)
def streak(spark, d):
    daily = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return A.streak(daily, "user_id", "day", F.col("v") >= 40)


@q(
    "running_budget",
    "SELECT * FROM (SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events) WHERE spent <= 300",
    "G16",
)
def running_budget(spark, d):
    w = W.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return events(spark, d).select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("spent")).filter("spent <= 300")


@q("normalise_max", "SELECT event_id, round(value / nullif(max(value) OVER (PARTITION BY event_type), 0), 8) AS share FROM events", "W15")
def normalise_max(spark, d):
    return A.over_max(events(spark, d), "event_type", "value").select("event_id", F.round("share", 8).alias("share"))


@q("trailing_count", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)", "W11 X9")
def trailing_count(spark, d):
    return A.trailing(events(spark, d), "user_id", "ts", 6 * 3600, {"n": F.count("*"), "total": F.sum("value")}).select("event_id", "n", F.round("total", 4).alias("total"))


@q("silence_start", f"SELECT event_id, epoch(max(ts) OVER (PARTITION BY user_id))::BIGINT - epoch(ts)::BIGINT AS silent FROM events WHERE ts <= TIMESTAMP '{AS_OF}'", "W13")
def silence_start(spark, d):
    e = events(spark, d).filter(F.col("ts") <= F.lit(AS_OF))
    sec = lambda c: F.rint(c.cast("double")).cast("long")  # noqa: E731  half a second goes to the even one, as in the SQL
    return e.select("event_id", (sec(F.max("ts").over(W.partitionBy("user_id"))) - sec(F.col("ts"))).alias("silent"))


@q("percentile_tiers", "SELECT event_id, CASE WHEN p >= 0.7 THEN 'full' WHEN p >= 0.4 THEN 'summary' WHEN p >= 0.1 THEN 'reference' ELSE 'dropped' END AS tier FROM (SELECT event_id, percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS p FROM events)", "W14 C36")
def percentile_tiers(spark, d):
    p = F.percent_rank().over(W.partitionBy("event_type").orderBy("value"))
    return events(spark, d).select("event_id", F.when(p >= 0.7, "full").when(p >= 0.4, "summary").when(p >= 0.1, "reference").otherwise("dropped").alias("tier"))


@q(
    "user_sessions",
    "SELECT user_id, session::BIGINT AS session, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY 1, 2",
    "X7",
)
def user_sessions(spark, d):
    return A.sessions(events(spark, d), "user_id", "ts", 14400, "event_id").groupBy("user_id", "session").agg(F.count("*").alias("n"))


@q("turn_links", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations", "W9 S15")
def turn_links(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@q("history_page", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) BETWEEN 2 AND 3", "E26")
def history_page(spark, d):
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("r", r).filter("r BETWEEN 2 AND 3").select("conv_id", "turn", "role")


# -- time ---------------------------------------------------------------------------------------------------


@q("snapshot_at", f"SELECT event_type, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1", "E1")
def snapshot_at(spark, d):
    return events(spark, d).filter(F.col("ts") <= F.lit(AS_OF)).groupBy("event_type").agg(F.count("*").alias("n"))


@q(
    "snapshot_diff",
    "WITH v AS (SELECT o_custkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders), a AS (SELECT * FROM v WHERE f <= TIMESTAMP '1996-01-01' AND (t IS NULL OR t > TIMESTAMP '1996-01-01')), b AS (SELECT * FROM v WHERE f <= TIMESTAMP '1996-06-01' AND (t IS NULL OR t > TIMESTAMP '1996-06-01')) "
    "SELECT coalesce(b.o_custkey, a.o_custkey) AS id, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.o_custkey = b.o_custkey WHERE a.f IS DISTINCT FROM b.f",
    "E2 E10 J15",
)
def snapshot_diff(spark, d):
    v = V.intervals(table(spark, d, "orders").withColumn("id", F.col("o_custkey")).withColumn("t", F.col("o_orderdate").cast("timestamp")), "id", "t", "o_orderkey")
    return V.diff(v, "1996-01-01", "1996-06-01")


@q("system_time_between", "SELECT o_orderkey FROM (SELECT *, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders) WHERE f <= TIMESTAMP '1997-03-01' AND (t IS NULL OR t > TIMESTAMP '1997-01-01')", "E8 E9")
def system_time_between(spark, d):
    v = V.intervals(table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp")), "o_custkey", "t", "o_orderkey")
    return V.system_time(v, "BETWEEN", "1997-01-01", "1997-03-01").select("o_orderkey")


@q("activity_buckets", f"SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1", "E3 X10")
def activity_buckets(spark, d):
    return events(spark, d).groupBy(shown(A.minute_bucket(F.col("ts"), 15)).alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@q("activity_by_agent", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 10", "E7 T9 S25")
def activity_by_agent(spark, d):
    return A.capped(events(spark, d), "user_id", [F.desc("ts"), "event_id"], 10).select("user_id", "event_id", "event_type")


@q("freshness_class", f"SELECT c, count(*) AS n FROM (SELECT CASE WHEN d <= 2 THEN 'fresh' WHEN d <= 7 THEN 'recent' WHEN d <= 30 THEN 'aging' WHEN d <= 90 THEN 'stale' ELSE 'historical' END AS c FROM (SELECT date_diff('day', ts::DATE, DATE '2024-02-01') AS d FROM events)) GROUP BY 1", "C23")
def freshness_class(spark, d):
    return events(spark, d).groupBy(A.freshness(F.col("ts"), F.lit("2024-02-01").cast("date")).alias("c")).agg(F.count("*").alias("n"))


@q("confidence_decay", "SELECT event_id, round(least(1.0, 0.8 * pow(0.5, date_diff('day', ts::DATE, DATE '2024-02-01') / 28.0) + least(0.3, (user_id % 40) * 0.02) + CASE WHEN user_id % 2 > 0 THEN 0.1 ELSE 0.0 END), 8) AS confidence FROM events", "E15")
def confidence_decay(spark, d):
    age = F.datediff(F.lit("2024-02-01").cast("date"), "ts")
    c = A.confidence(F.lit(0.8), age, F.col("user_id") % 40, F.col("user_id") % 2)
    return events(spark, d).select("event_id", F.round(c, 8).alias("confidence"))


@q(
    "silence_decay_score",
    f"SELECT user_id, round(greatest(-1.0, least(1.0, sum(CASE WHEN h <= 6 THEN v ELSE v / (1 + r * ln(1 + h - 6)) END))), 6) AS score FROM (SELECT user_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3600000000.0 AS h, CASE {SENTIMENT[5:-4]} END AS s, CASE WHEN event_type IN ('purchase', 'signup') THEN 0.1 WHEN event_type = 'error' THEN -0.1 ELSE 0.0 END AS v, CASE event_type WHEN 'error' THEN 0.05 WHEN 'purchase' THEN 0.10 ELSE 0.15 END AS r FROM events WHERE ts <= TIMESTAMP '{AS_OF}') GROUP BY 1",
    "E14 A28",
)
def silence_decay_score(spark, d):
    e = events(spark, d).filter(F.col("ts") <= F.lit(AS_OF))
    h = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("ts")) / 3_600_000_000
    v = F.expr("CASE WHEN event_type IN ('purchase', 'signup') THEN 0.1D WHEN event_type = 'error' THEN -0.1D ELSE 0.0D END")
    impact = F.expr("CASE event_type WHEN 'error' THEN 'breaking' WHEN 'purchase' THEN 'high' ELSE 'medium' END")
    s = F.sum(A.silence_decay(v, h, impact))
    return e.groupBy("user_id").agg(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)), 6).alias("score"))


@q(
    "prune_actions",
    "SELECT action, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('signup') THEN 'keep' WHEN event_type IN ('view') AND d > 7 THEN 'delete' WHEN value / 100 < 0.2 THEN 'quarantine' WHEN user_id % 3 = 0 AND d > 30 THEN 'archive' ELSE 'keep' END AS action FROM (SELECT *, date_diff('day', ts::DATE, DATE '2024-02-10') AS d FROM events)) GROUP BY 1",
    "E18 E19 E17",
)
def prune_actions(spark, d):
    age = F.datediff(F.lit("2024-02-10").cast("date"), "ts")
    return events(spark, d).groupBy(A.prune_action(F.col("event_type"), age, F.col("value") / 100, F.col("user_id") % 3, ["view"], ["signup"]).alias("action")).agg(F.count("*").alias("n"))


@q("memory_decay", "SELECT event_id, round(greatest(0.1, 1.0 - date_diff('day', ts::DATE, DATE '2024-02-01') * 0.05), 6) AS linear, round(0.5 + (0.9 - 0.5) * pow(0.99, date_diff('day', ts::DATE, DATE '2024-02-01')), 6) AS useful FROM events", "E16 E17")
def memory_decay(spark, d):
    age = F.datediff(F.lit("2024-02-01").cast("date"), "ts")
    return events(spark, d).select("event_id", F.round(A.linear_decay(F.lit(1.0), age, 0.05, 0.1), 6).alias("linear"), F.round(A.toward_half(F.lit(0.9), age), 6).alias("useful"))


_DIST = "sum((s = 'positive')::BIGINT)::BIGINT AS positive, sum((s = 'negative')::BIGINT)::BIGINT AS negative, sum((s = 'neutral')::BIGINT)::BIGINT AS neutral, (sum((s = 'positive')::BIGINT) - sum((s = 'negative')::BIGINT))::BIGINT AS net, count(*) AS total"


@q("sentiment_buckets", f"SELECT strftime(ts, '%Y-%m-%d') AS bucket, {_DIST} FROM (SELECT ts, {SENTIMENT} AS s FROM events) GROUP BY 1", "A20 E12")
def sentiment_buckets(spark, d):
    return A.distribution(signals(spark, d), A.bucket(F.col("ts"), "day").alias("bucket"))


@q("sentiment_weeks", f"SELECT strftime(date_trunc('week', ts), '%Y-%W') AS bucket, {_DIST} FROM (SELECT ts, {SENTIMENT} AS s FROM events) GROUP BY 1", "A20 E12")
def sentiment_weeks(spark, d):
    return A.distribution(signals(spark, d), A.bucket(F.col("ts"), "week").alias("bucket"))


@q("compare_entities", f"SELECT user_id, {_DIST} FROM (SELECT user_id, {SENTIMENT} AS s FROM events) GROUP BY 1", "A21")
def compare_entities(spark, d):
    return A.distribution(signals(spark, d), "user_id")


@q(
    "polarity_reversal",
    f"WITH s AS (SELECT *, {SENTIMENT} AS s FROM events), w AS (SELECT *, count(*) FILTER (s = 'positive') OVER x AS p, count(*) FILTER (s = 'negative') OVER x AS n FROM s WINDOW x AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING)) SELECT event_id, s AS sentiment FROM w WHERE (s = 'positive' AND n > p) OR (s = 'negative' AND p > n)",
    "W12 E21 A26",
)
def polarity_reversal(spark, d):
    return A.reversals(signals(spark, d), "user_id", "ts", 172800, "event_id").select("event_id", "sentiment")


@q("threshold_breach", f"SELECT user_id, count(*) AS breaches FROM events WHERE value > 80 AND ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1 HAVING count(*) >= 5", "A27 E21")
def threshold_breach(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    return A.breaches(events(spark, d), "user_id", F.col("value") > 80, at("2024-01-05"), at(AS_OF), "ts", 5)


@q("daily_corr", f"WITH d AS ({DAILY}) SELECT event_type, round(coalesce(corr(n, v), 0), 5) AS r, count(*) AS days FROM d GROUP BY 1", "A22 A23 E20")
def daily_corr(spark, d):
    daily = events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    return daily.groupBy("event_type").agg(F.round(A.pearson("n", "v"), 5).alias("r"), F.count("*").alias("days"))


@q(
    "causal_pairs",
    f"WITH s AS (SELECT *, {SENTIMENT} AS s FROM events), p AS (SELECT a.event_type AS cause, b.event_type AS effect, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS lag, a.s = b.s AS aligned FROM s a JOIN s b ON a.user_id = b.user_id AND a.ts < b.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000) SELECT cause, effect, count(*) AS n, round(avg(lag), 3) AS mean_lag, round(avg(aligned::DOUBLE), 6) AS alignment, round(least(1.0, count(*) / 5.0) * (0.5 + 0.5 * avg(aligned::DOUBLE)), 6) AS confidence FROM p GROUP BY 1, 2",
    "A24 E20",
)
def causal_pairs(spark, d):
    s = signals(spark, d)
    a = s.select("user_id", F.col("event_type").alias("cause"), F.col("ts").alias("ta"), F.col("sentiment").alias("sa"))
    b = s.select("user_id", F.col("event_type").alias("effect"), F.col("ts").alias("tb"), F.col("sentiment").alias("sb"))
    pairs = A.range_join(a, b, "ta", "tb", 3600, ["user_id"]).filter("ta < tb")
    pairs = pairs.select("cause", "effect", ((F.unix_micros("tb") - F.unix_micros("ta")) / 1e6).alias("lag"), (F.col("sa") == F.col("sb")).alias("aligned"))
    out = A.causal_chains(pairs)
    return out.withColumns({"mean_lag": F.round("mean_lag", 3), "alignment": F.round("alignment", 6), "confidence": F.round("confidence", 6)})


@q(
    "bridge_entities",
    f"WITH s AS (SELECT user_id, event_type, {SENTIMENT} AS s FROM events), m AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, (SELECT count(DISTINCT event_type) FROM s x WHERE x.user_id = m.user_id) AS contexts, arg_min(s, (-n, s)) AS dominant FROM m GROUP BY 1 HAVING contexts >= 2",
    "A25",
)
def bridge_entities(spark, d):
    return A.bridges(signals(spark, d), "user_id", "event_type", "sentiment")


@q(
    "macro_score",
    f"SELECT user_id, m AS macro, CASE WHEN m > 0.3 THEN 'bullish' WHEN m < -0.3 THEN 'bearish' ELSE 'neutral' END AS band FROM (SELECT user_id, round(greatest(-1, least(1, sum(value * s) / nullif(sum(value), 0))), 6) AS m FROM (SELECT user_id, value, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS s FROM events) GROUP BY 1)",
    "A29 E23",
)
def macro_score(spark, d):
    s = F.expr("CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0D WHEN event_type = 'error' THEN -1.0D ELSE 0.0D END")
    return A.macro_score(events(spark, d).withColumns({"score": s, "weight": F.col("value")}), "user_id").withColumn("macro", F.round("macro", 6))


@q(
    "score_timeline",
    f"SELECT strftime(p, '%Y-%m-%d') AS point, round(sum(CASE WHEN h <= 6 THEN v ELSE v / (1 + 0.15 * ln(1 + h - 6)) END), 5) AS score FROM (SELECT p, (epoch_us(p) - epoch_us(ts)) / 3600000000.0 AS h, value AS v FROM (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', INTERVAL 2 DAY)) AS p), events WHERE ts <= p AND event_type = 'error') GROUP BY 1",
    "W16",
)
def score_timeline(spark, d):
    points = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-13").cast("timestamp"), F.expr("INTERVAL 2 DAYS"))).alias("p"))
    e = events(spark, d).filter("event_type = 'error'").select("ts", "value")
    j = e.join(points, F.col("ts") <= F.col("p"))
    h = (F.unix_micros("p") - F.unix_micros("ts")) / 3_600_000_000
    return j.groupBy(F.date_format("p", "yyyy-MM-dd").alias("point")).agg(F.round(F.sum(A.silence_decay(F.col("value"), h, F.lit("medium"))), 5).alias("score"))


@q("learned_weights", "SELECT user_id, round(list_reduce(list_prepend(0.5::DOUBLE, v), lambda s, a: greatest(0.05, least(1.0, s * 0.8 + a * 0.2))), 6) AS weight, round(list_sum(list_transform(v, lambda a: abs(a - 0.5))) / len(v), 6) AS error, round(least(1.0, len(v) / 30.0), 6)::DOUBLE AS confidence FROM (SELECT user_id, list((value / 100)::DOUBLE ORDER BY ts, event_id) AS v FROM events GROUP BY 1)", "A35")
def learned_weights(spark, d):
    out = A.learned_weight(events(spark, d).withColumn("a", F.col("value") / 100).withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "a")
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "error", "confidence")})


@q("gap_frequency", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id LIMIT 25", "A36")
def gap_frequency(spark, d):
    return events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "user_id").limit(25)


@q("rollup_extension", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "A37 A38 A14")
def rollup_extension(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# -- rules --------------------------------------------------------------------------------------------------


@q("rule_sum", "SELECT 'big' AS rule, l_suppkey::VARCHAR AS subject, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey HAVING sum(l_extendedprice) > 500000", "A15 Q3 Q1")
def rule_sum(spark, d):
    r = A.Rule("big", "sum", "gt", 500000, "l_extendedprice", "l_suppkey", where="l_returnflag = 'R'")
    return A.engine([r], table(spark, d, "lineitem")).withColumn("value", F.round("value", 2))


@q("rule_top_n_sum", "SELECT 'top' AS rule, 'all' AS subject, round(sum(v), 2) AS value FROM (SELECT o_totalprice AS v FROM orders ORDER BY 1 DESC LIMIT 10)", "A16 Q3")
def rule_top_n_sum(spark, d):
    return A.evaluate(A.Rule("top", "top_n_sum", "gt", 0, "o_totalprice", n=10), table(spark, d, "orders")).withColumn("value", F.round("value", 2))


@q("rule_count_ratio", "SELECT 'late' AS rule, o_orderpriority AS subject, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 8) AS value FROM orders GROUP BY 2 HAVING avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) >= 0.3", "A17 Q3 Q6")
def rule_count_ratio(spark, d):
    return A.evaluate(A.Rule("late", "count_ratio", "gte", 0.3, group="o_orderpriority", where="o_orderstatus = 'F'"), table(spark, d, "orders")).withColumn("value", F.round("value", 8))


@q("rule_yaml", "SELECT 'poor' AS rule, c_custkey::VARCHAR AS subject, c_acctbal AS value FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'many', c_nationkey::VARCHAR, count(*)::DOUBLE FROM customer GROUP BY c_nationkey HAVING count(*) > 60", "Q2 Q5 Q7")
def rule_yaml(spark, d):
    text = "- {name: poor, kind: custom, compare: lt, threshold: -900, value: c_acctbal, group: c_custkey}\n- {name: many, kind: sum, compare: gt, threshold: 60, group: c_nationkey}\n"
    return A.engine(A.load_rules(text), table(spark, d, "customer"))


@q(
    "concentration_metrics",
    "WITH b AS (SELECT s_nationkey AS g, l_partkey AS k, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), r AS (SELECT *, sum(v) OVER (PARTITION BY g) AS t, row_number() OVER (PARTITION BY g ORDER BY v DESC, k) AS n FROM b) SELECT g AS s_nationkey, round(max(t), 2) AS total, count(*) AS positions, round(max(v / t), 8) AS largest_share, round(sum(CASE WHEN n <= 5 THEN v / t END), 8) AS top5_share FROM r GROUP BY 1",
    "A18",
)
def concentration_metrics(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    out = A.concentration(l, "s_nationkey", "l_partkey", "l_extendedprice")
    return out.withColumns({"total": F.round("total", 2), "largest_share": F.round("largest_share", 8), "top5_share": F.round("top5_share", 8)})


@q("derive_edge_count", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15", "Q8 Q9")
def derive_edge_count(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).filter("n >= 15")


@q("pre_action", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -950)", "Q5")
def pre_action(spark, d):
    blocked = table(spark, d, "customer").filter("c_acctbal < -950").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(blocked, "o_custkey", "left_semi").select("o_orderkey")
