"""Windows, temporal and event analytics, correlation, rules and derivations as DataFrame operators.

Nothing here calls now(): what depends on the present takes an explicit instant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# -- joins ------------------------------------------------------------------------------------------------


def range_join(left: DataFrame, right: DataFrame, lt: str, rt: str, seconds: int, on: list[str] | None = None) -> DataFrame:
    """Pairs whose times differ by at most `seconds` (and agree on `on`): an equi-join on time buckets, the left
    side in its bucket and both neighbours, so that each pair meets exactly once."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    a = left.withColumn("_b", F.explode(F.array(bucket(lt) - 1, bucket(lt), bucket(lt) + 1)))
    b = right.withColumn("_b", bucket(rt))
    near = F.abs(F.unix_micros(F.col(lt).cast("timestamp")) - F.unix_micros(F.col(rt).cast("timestamp"))) <= seconds * 1_000_000
    return a.join(b, ["_b", *(on or [])]).filter(near).drop("_b")


def shared_field(df: DataFrame, key: str, field: str) -> DataFrame:
    """(a, b) of rows that share a field, a < b."""
    x = df.select(F.col(key).alias("a"), F.col(field).alias("_f")).filter("_f IS NOT NULL")
    y = df.select(F.col(key).alias("b"), F.col(field).alias("_f"))
    return x.join(y, "_f").filter("a < b").select("a", "b", F.col("_f").alias(field))


#: Rows of a partition of items that are paired; its pairs and their counts are what a task holds.
PAIRED = 250_000


def cooccurrence(df: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, weight): distinct groups in which both items are, a < b.

    Rows are dealt by group and pairs by their ends over partitions whose number grows with the rows, so that what a task sorts and
    counts doesn't; pairs hardly repeat before they meet, so they aren't counted in part first."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PAIRED))
    d = df.select(group, item).repartition(parts, group).distinct()
    x, y = d.withColumnRenamed(item, "a"), d.withColumnRenamed(item, "b")
    met = x.join(y, group).filter("a < b").select("a", "b").repartition(parts, "a", "b")
    return met.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def proximity(df: DataFrame, doc: str, place: str, label: str, most: int = 3) -> DataFrame:
    """(doc, a, b, distance) of labels within 1 .. most places, each pair at its smallest distance."""
    x = df.select(doc, F.col(place).alias("p"), F.col(label).alias("a")).withColumn("q", F.explode(F.sequence(F.col("p") + 1, F.col("p") + most)))
    y = df.select(doc, F.col(place).alias("q"), F.col(label).alias("b"))
    return x.join(y, [doc, "q"]).groupBy(doc, "a", "b").agg(F.min(F.col("q") - F.col("p")).alias("distance"))


# -- windows -----------------------------------------------------------------------------------------------


def capped(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def over_max(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds share: value over the largest of its group."""
    return df.withColumn("share", F.coalesce(F.try_divide(F.col(value), F.max(value).over(W.partitionBy(group))), F.lit(0.0)))


def streak(df: DataFrame, key: str, day: str, ok: Column) -> DataFrame:
    """(key, streak): how many of the last observed days in a row satisfy ok, one value a day."""
    flag = df.select(key, day, ok.cast("int").alias("_ok"))
    broken = F.sum(1 - F.col("_ok")).over(W.partitionBy(key).orderBy(F.desc(day)).rowsBetween(W.unboundedPreceding, 0))
    return flag.withColumn("_b", broken).groupBy(key).agg(F.sum(F.when(F.col("_b") == 0, 1).otherwise(0)).alias("streak"))


def change(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Adds previous and direction (up, down, same; null for the first)."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    direction = F.when(before.isNull(), None).when(F.col(value) > before, "up").when(F.col(value) < before, "down").otherwise("same")
    return df.withColumns({"previous": before, "direction": direction})


def trailing(df: DataFrame, key: str, ts: str, seconds: int, aggregates: dict[str, Column]) -> DataFrame:
    """Adds aggregates over the rows of the last `seconds`, this one included."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumns({n: c.over(w) for n, c in aggregates.items()})


def sessions(df: DataFrame, key: str, ts: str, gap: int, *tie: str) -> DataFrame:
    """Adds session (from 1): a new one begins after more than `gap` seconds."""
    order = W.partitionBy(key).orderBy(ts, *tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce(micros - F.lag(micros).over(order) > gap * 1_000_000, F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


# -- time ---------------------------------------------------------------------------------------------------


def freshness(day: Column, today: Column) -> Column:
    d = F.datediff(today, day)
    return F.when(d <= 2, "fresh").when(d <= 7, "recent").when(d <= 30, "aging").when(d <= 90, "stale").otherwise("historical")


def confidence(base: Column, age_days: Column, uses: Column, sources: Column, half_life: float = 28.0) -> Column:
    """Halves every half_life days; use holds it up by .3 at most, sources by .1."""
    decayed = base * F.pow(F.lit(0.5), age_days / half_life)
    return F.least(F.lit(1.0), decayed + F.least(F.lit(0.3), uses * 0.02) + F.when(sources > 0, 0.1).otherwise(0.0))


# Rates of decay by impact.
RATES = {"breaking": 0.05, "high": 0.10, "medium": 0.15, "low": 0.22, "rumor": 0.35}


def silence_decay(value: Column, hours: Column, impact: Column, quiet: float = 6.0) -> Column:
    """value / (1 + rate * ln(1 + hours - quiet)) once it has been quiet for longer than that."""
    rate = F.lit(0.15)
    for k, r in RATES.items():
        rate = F.when(impact == k, r).otherwise(rate)
    return F.when(hours <= quiet, value).otherwise(value / (1 + rate * F.log(1 + hours - quiet)))


def linear_decay(value: Column, age_days: Column, rate: float, least: float) -> Column:
    return F.greatest(F.lit(least), value - age_days * rate)


def toward_half(value: Column, days: Column, rate: float = 0.01) -> Column:
    return 0.5 + (value - 0.5) * F.pow(F.lit(1 - rate), days)


def prune_action(label: Column, age_days: Column, confidence: Column, uses: Column, noise: list[str], evergreen: list[str]) -> Column:
    return (
        F.when(label.isin(evergreen), "keep")
        .when(label.isin(noise) & (age_days > 7), "delete")
        .when(confidence < 0.2, "quarantine")
        .when((uses == 0) & (age_days > 30), "archive")
        .otherwise("keep")
    )


def week_key(ts: Column) -> Column:
    """Year and number of the week, Mondays first, days before the first Monday in week 00."""
    monday = F.date_trunc("week", ts)
    return F.concat(F.date_format(monday, "yyyy"), F.lit("-"), F.lpad(F.floor((F.dayofyear(monday) + 6) / 7).cast("string"), 2, "0"))


def bucket(ts: Column, unit: str) -> Column:
    return week_key(ts) if unit == "week" else F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd HH:00" if unit == "hour" else "yyyy-MM-dd")


def minute_bucket(ts: Column, minutes: int) -> Column:
    """Start of the bucket within the hour; 60 and more give the hour."""
    m = min(minutes, 60)
    return F.timestamp_micros(F.unix_micros(F.date_trunc("hour", ts)) + (F.floor(F.minute(ts) / m) * m * 60_000_000).cast("long"))


# -- signals ------------------------------------------------------------------------------------------------


def distribution(df: DataFrame, *by) -> DataFrame:
    """positive, negative, neutral, net and total by the given columns, from a column sentiment."""
    one = lambda s: F.sum((F.col("sentiment") == s).cast("long"))
    return df.groupBy(*by).agg(one("positive").alias("positive"), one("negative").alias("negative"), one("neutral").alias("neutral"), (one("positive") - one("negative")).alias("net"), F.count("*").alias("total"))


def reversals(df: DataFrame, key: str, ts: str, seconds: int, tie: str) -> DataFrame:
    """Rows whose sentiment is opposite to the more frequent one of the trailing window before them."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, -1)
    n = lambda s: F.sum((F.col("sentiment") == s).cast("long")).over(w)
    p, m = F.coalesce(n("positive"), F.lit(0)), F.coalesce(n("negative"), F.lit(0))
    dominant = F.when(p > m, "positive").when(m > p, "negative").otherwise("neutral")
    df = df.withColumn("dominant", dominant)
    return df.filter(((F.col("sentiment") == "positive") & (F.col("dominant") == "negative")) | ((F.col("sentiment") == "negative") & (F.col("dominant") == "positive")))


def breaches(df: DataFrame, key: str, ok: Column, start: Column, end: Column, ts: str, least: int) -> DataFrame:
    return df.filter(ok & (F.col(ts) > start) & (F.col(ts) <= end)).groupBy(key).agg(F.count("*").alias("breaches")).filter(F.col("breaches") >= least)


def pearson(x: str, y: str) -> Column:
    """From moments; 0 below three pairs or without variance."""
    n = F.count(F.col(x) + F.col(y)).cast("double")
    xs, ys = F.sum(F.when(F.col(y).isNotNull(), F.col(x))), F.sum(F.when(F.col(x).isNotNull(), F.col(y)))
    xx, yy, xy = F.sum(F.when(F.col(y).isNotNull(), F.col(x) * F.col(x))), F.sum(F.when(F.col(x).isNotNull(), F.col(y) * F.col(y))), F.sum(F.col(x) * F.col(y))
    vx, vy = n * xx - xs * xs, n * yy - ys * ys
    return F.when((n < 3) | (vx <= 0) | (vy <= 0), 0.0).otherwise((n * xy - xs * ys) / F.sqrt(vx) / F.sqrt(vy))


def causal_chains(pairs: DataFrame) -> DataFrame:
    """(cause, effect, n, mean_lag, alignment, confidence) from pairs (cause, effect, lag, aligned)."""
    out = pairs.groupBy("cause", "effect").agg(F.count("*").alias("n"), F.avg("lag").alias("mean_lag"), F.avg(F.col("aligned").cast("double")).alias("alignment"))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 5) * (0.5 + 0.5 * F.col("alignment")))


def bridges(df: DataFrame, entity: str, context: str, value: str, least: int = 2) -> DataFrame:
    """(entity, contexts, dominant): entities of several contexts and their most frequent value, the smallest of equals."""
    n = df.groupBy(entity, value).agg(F.count("*").alias("n"))
    mode = n.groupBy(entity).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("dominant"))
    return df.groupBy(entity).agg(F.count_distinct(context).alias("contexts")).filter(F.col("contexts") >= least).join(mode, entity)


def macro_score(df: DataFrame, key: str) -> DataFrame:
    """(key, macro): weighted mean of score in -1 .. 1; and its band."""
    s = F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")), F.lit(0.0))
    out = df.groupBy(key).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)).alias("macro"))
    return out.withColumn("band", F.when(F.col("macro") > 0.3, "bullish").when(F.col("macro") < -0.3, "bearish").otherwise("neutral"))


def learned_weight(df: DataFrame, key: str, order: str, actual: str, start: float = 0.5, rate: float = 0.2) -> DataFrame:
    """(key, weight, error, confidence): an exponential mean of actual in order, within .05 and 1, a key at a time."""
    held = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(actual).cast("double").alias("a")))), lambda s: s["a"]).alias("v"))
    w = F.aggregate("v", F.lit(start), lambda s, a: F.greatest(F.lit(0.05), F.least(F.lit(1.0), s * (1 - rate) + a * rate)))
    err = F.aggregate("v", F.lit(0.0), lambda s, a: s + F.abs(a - start)) / F.size("v")
    return held.select(key, w.alias("weight"), err.alias("error"), F.least(F.lit(1.0), F.size("v") / 30).alias("confidence"))


# -- rules --------------------------------------------------------------------------------------------------

COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: ~a.eqNullSafe(b)}


@dataclass(frozen=True)
class Rule:
    """kind: sum, top_n_sum, count_ratio, custom. The result is one row for each group that breaks the rule."""

    name: str
    kind: str
    compare: str
    threshold: float
    value: str | None = None
    group: str | None = None
    n: int = 0
    where: str | None = None
    trigger: str = "always"


def evaluate(rule: Rule, df: DataFrame) -> DataFrame:
    """(rule, subject, value) of the groups that meet the comparison."""
    group = F.col(rule.group).cast("string") if rule.group else F.lit("all")
    v = F.col(rule.value).try_cast("double") if rule.value else F.lit(1.0)
    if rule.kind == "sum":
        out = df.filter(rule.where or "true").groupBy(group.alias("subject")).agg(F.sum(v).alias("value"))
    elif rule.kind == "top_n_sum":
        out = df.filter(rule.where or "true").orderBy(v.desc_nulls_last()).limit(rule.n).agg(F.sum(v).alias("value")).select(F.lit("all").alias("subject"), "value")
    elif rule.kind == "count_ratio":
        out = df.groupBy(group.alias("subject")).agg(F.avg(F.when(F.expr(rule.where), 1.0).otherwise(0.0)).alias("value"))
    else:
        out = df.filter(rule.where or "true").select(group.alias("subject"), v.alias("value"))
    return out.filter(COMPARE[rule.compare](F.col("value"), F.lit(rule.threshold))).select(F.lit(rule.name).alias("rule"), "subject", "value")


def engine(rules: list[Rule], df: DataFrame, trigger: str = "always") -> DataFrame:
    """The results of all rules of a trigger in one plan."""
    out = None
    for r in rules:
        if r.trigger in (trigger, "always"):
            one = evaluate(r, df)
            out = one if out is None else out.unionByName(one)
    return out


def load_rules(text: str) -> list[Rule]:
    """Rules from YAML: a list of mappings with the fields of Rule."""
    import yaml

    return [Rule(**r) for r in yaml.safe_load(text)]


def concentration(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, total, positions, largest_share, top5_share) of the values of keys."""
    by = df.groupBy(group, key).agg(F.sum(value).alias("v"))
    r = by.withColumns({"t": F.sum("v").over(W.partitionBy(group)), "n": F.row_number().over(W.partitionBy(group).orderBy(F.desc("v"), key))})
    return r.groupBy(group).agg(F.max("t").alias("total"), F.count("*").alias("positions"), F.max(F.col("v") / F.col("t")).alias("largest_share"), F.sum(F.when(F.col("n") <= 5, F.col("v") / F.col("t"))).alias("top5_share"))


def granted(local: DataFrame, shared: DataFrame, grants: DataFrame, labels: list[str]) -> DataFrame:
    """Local rows and those of granted namespaces that are public and of the labels; adds origin."""
    other = shared.filter((F.col("visibility") == "PUBLIC") & F.col("label").isin(labels)).join(grants, "ns", "left_semi")
    return local.withColumn("origin", F.lit("local")).unionByName(other.withColumn("origin", F.col("ns")).drop("ns", "visibility"), allowMissingColumns=True)
