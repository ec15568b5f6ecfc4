"""Mixing sources to target weights by budgets that run down a tree of domain, language and source.

Capacities (tokens times the most epochs) add up from the leaves. The budget of a node is shared among its
children by weight; a child that can't use its share is filled and what it leaves goes to its siblings,
so a shortage reaches the ancestors' level only when a whole family is full. All sums are whole numbers;
what rounding down leaves over is less than a token a child.

A leaf with budget b and t tokens gives b div t whole epochs and a prefix of one more: each epoch is a
seeded order of its documents, and the prefix ends with the document that reaches the budget (that
document's `taken_tokens` says how many of its tokens count).

Defined results: documents without words (null or empty text) have no tokens and are never selected;
null domains, languages and sources form nodes of their own, and weights that the tree doesn't name are
1; a weight of 0 excludes a subtree; an empty table gives no rows; extra columns pass through whatever their names,
one named as an output is replaced. Rows with equal ids (null ones too) and token counts follow a digest of the
whole row; rows that are equal in all columns are counted and come together. A very long text is one document: the
prefix ends inside it if its tokens reach the budget. DataFrame expressions only. The end of a leaf's prefix is found
from sums of at most 256 buckets at a time, so a hot leaf is never one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.llm.shared import WORD, written

LEVELS = ("domain", "lang", "source")
#: Documents of a leaf among which the end of its prefix is looked for row by row.
EDGE_DOCS = 500
#: Bytes of a row's place in the order.
DEPTHS = 24
WIDE = "decimal(38,0)"


def n_tokens(text: str = "text") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def weight(level: int, keys: tuple[str, ...], weights: Mapping[tuple, int]) -> Column:
    """The weight of a node from a mapping path -> whole number; 1 where the mapping has nothing."""
    out = None
    for path, w in sorted(weights.items(), key=str):
        if len(path) == level + 1:
            at = F.lit(True)
            for k, v in zip(keys, path, strict=False):
                at = at & F.col(k).eqNullSafe(F.lit(v))
            out = F.when(at, w) if out is None else out.when(at, w)
    return (F.lit(1) if out is None else out.otherwise(1)).cast("long")


def fill(children: DataFrame, parent: tuple[str, ...], key: str) -> DataFrame:
    """Shares `budget` (of the parent, on every row) by `w` within `cap`; adds `given`."""
    near = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = near.orderBy(F.col("cap").cast("double") / F.col("w"), F.col(key).asc_nulls_first())
    before = F.coalesce(F.sum(F.col("cap").cast(WIDE)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(WIDE))
    left = F.col("budget").cast(WIDE) - before
    behind = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    df = children.withColumns({"_rank": F.row_number().over(order), "_left": left, "_behind": behind})
    df = df.withColumn("_fits", F.col("_left") * F.col("w") <= F.col("cap").cast(WIDE) * F.col("_behind"))
    df = df.withColumn("_first", F.min(F.when(F.col("_fits"), F.col("_rank"))).over(near))
    df = df.withColumns({c: F.max(F.when(F.col("_rank") == F.col("_first"), F.col(c))).over(near) for c in ("_left", "_behind")})
    share = F.expr("CAST((_left * w) div _behind AS bigint)")
    return df.withColumn("given", F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first")), F.col("cap")).otherwise(share)).drop("_rank", "_left", "_behind", "_fits", "_first")


def budgets(leaves: DataFrame, total: int, weights: Mapping[tuple, int], epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """leaves: one row a leaf with `tokens`; adds `budget`. Its size is that of the tree, not of the corpus."""
    tree = leaves.withColumn("cap", F.col("tokens") * epochs)
    for k in range(len(levels)):
        tree = tree.filter(weight(k, levels[: k + 1], weights) > 0)
    above = None
    for k in range(len(levels)):
        keys = levels[: k + 1]
        rows = tree.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", weight(k, keys, weights))
        if above is None:
            rows = rows.withColumn("budget", F.lit(total).cast("long"))
        else:
            up = above.select(*[F.col(c).alias(f"_{c}") for c in levels[:k]], F.col("given").alias("budget"))
            on = [rows[c].eqNullSafe(up[f"_{c}"]) for c in levels[:k]]
            rows = rows.join(up, on).drop(*[f"_{c}" for c in levels[:k]])
        above = fill(rows, levels[:k], levels[k])
    return above.select(*levels, F.col("given").alias("budget"))


def mixed(docs: DataFrame, share: tuple[int, int], weights: Mapping[tuple, int], seed: int, epochs: int = 4, doc_id: str = "doc_id", levels: tuple[str, ...] = LEVELS, edge_docs: int = EDGE_DOCS) -> DataFrame:
    """Selects documents to the weights; share is (a, b) for a budget of a/b of all tokens.

    docs must have `tokens` and the levels and should be a written table, as it is read more than once.
    Adds epoch (from 0) and taken_tokens; one row for each time that a document is taken.
    """
    inputs = [c for c in docs.columns if c not in ("epoch", "taken_tokens")]
    some = docs.filter(F.col("tokens") > 0)
    leaves = written(some.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    given = budgets(leaves, total * share[0] // share[1], weights, epochs, levels).select(*[F.col(c).alias(f"up_{c}") for c in levels], "budget")
    plan = leaves.join(given, [leaves[c].eqNullSafe(given[f"up_{c}"]) for c in levels])
    plan = plan.select(*[F.col(c).alias(f"leaf_{c}") for c in levels], F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest"), F.monotonically_increasing_id().alias("leaf"))
    plan = written(plan, "plan")
    rows = some.select(F.struct(*inputs).alias("row"), F.col("tokens").alias("t"), *[F.col(c).alias(f"own_{c}") for c in levels], F.col(doc_id).cast("string").alias("id"))
    rows = rows.join(plan, [rows[f"own_{c}"].eqNullSafe(plan[f"leaf_{c}"]) for c in levels])
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce("id", F.lit("-")), F.col("t").cast("string")))
    rows = rows.select("row", "t", "leaf", "full", "rest", F.concat(order, F.lpad(F.hex(F.xxhash64("row")), 16, "0")).alias("place"))  # digests without ties
    output = [F.col("row")[c].alias(c) for c in inputs]
    head = lambda n: F.substring("place", 1, 2 * n)
    border = plan.filter("rest > 0").select("leaf", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for depth in range(1, DEPTHS + 1):
        # the bucket in which the prefix ends, one more byte of the order at a time: never over 256 sums a leaf
        inside = rows.join(border, "leaf").filter(head(depth - 1) == F.col("prefix"))
        sums = inside.groupBy("leaf", "rest", "before", head(depth).alias("bucket")).agg(F.sum("t").alias("t"), F.count("*").alias("n"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("t").over(W.partitionBy("leaf").orderBy("bucket")))
        last = upto.filter("upto > rest").groupBy("leaf").agg(F.min("bucket").alias("prefix"), F.min_by(F.col("upto") - F.col("t"), "bucket").alias("before"), F.min_by("n", "bucket").alias("n"))
        found = written(last, "border")
        border = found.select("leaf", "prefix", "before")
        if (found.agg(F.max("n")).first()[0] or 0) <= edge_docs:
            break
    at = rows.join(border, "leaf")
    prefix = at.filter(head(depth) < F.col("prefix")).select(*output, F.col("full").alias("epoch"), F.col("t").alias("taken_tokens"))
    edge = at.filter(head(depth) == F.col("prefix")).groupBy("leaf", "full", "rest", "before", "place", "t").agg(F.first("row").alias("row"), F.count("*").alias("n"))
    upto = F.sum(F.col("t") * F.col("n")).over(W.partitionBy("leaf").orderBy("place"))
    edge = edge.withColumn("start", F.col("before") + upto - F.col("t") * F.col("n")).filter("start < rest")
    edge = edge.withColumn("k", F.explode(F.expr("sequence(0L, least(n, (rest - start + t - 1) div t) - 1)")))  # equal rows were counted as one
    edge = edge.select(*output, F.col("full").alias("epoch"), F.expr("least(t, rest - start - k * t)").alias("taken_tokens"))
    whole = rows.filter("full > 0").select("row", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("e"))
    return whole.select(*output, F.col("e").alias("epoch"), F.col("t").alias("taken_tokens")).unionByName(prefix).unionByName(edge)


def tree_sql(source: str, total: str, weights: Mapping[tuple, int], epochs: int, levels: tuple[str, ...] = LEVELS) -> str:
    """The same budgets as WITH clauses of DuckDB; the last one is named `given`."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    def w(level):
        cases = "".join(f" WHEN {' AND '.join(f'{c} IS NOT DISTINCT FROM {quote(v)}' for c, v in zip(levels, path))} THEN {n}" for path, n in weights.items() if len(path) == level + 1)
        return f"(CASE{cases} ELSE 1 END)" if cases else "1"

    parts = [f"leaves AS (SELECT {', '.join(levels)}, sum(tokens)::HUGEINT AS tokens FROM {source} WHERE tokens > 0 GROUP BY ALL)", f"tree AS (SELECT *, tokens * {epochs} AS cap FROM leaves WHERE {' AND '.join(f'{w(k)} > 0' for k in range(len(levels)))})"]
    for k in range(len(levels)):
        keys, up = ", ".join(levels[: k + 1]), ", ".join(levels[:k])
        part = f"PARTITION BY {up} " if k else ""
        budget = f"(SELECT {total})::HUGEINT" if not k else "p.given"
        join = "" if not k else f" JOIN given_{k - 1} p ON {' AND '.join(f'n.{c} IS NOT DISTINCT FROM p.{c}' for c in levels[:k])}"
        parts += [
            f"nodes_{k} AS (SELECT {', '.join('n.' + c for c in levels[: k + 1])}, n.cap, n.w::HUGEINT AS w, {budget} AS budget FROM (SELECT {keys}, sum(cap) AS cap, {w(k)} AS w FROM tree GROUP BY {keys}) n{join})",
            f"ranked_{k} AS (SELECT *, row_number() OVER o AS r, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM nodes_{k} WINDOW o AS ({part}ORDER BY cap::DOUBLE / w, {levels[k]} NULLS FIRST))",
            f"first_{k} AS (SELECT *, min(CASE WHEN rest * w <= cap * behind THEN r END) OVER ({part}) AS f FROM ranked_{k})",
            f"given_{k} AS (SELECT {keys}, (CASE WHEN f IS NULL OR r < f THEN cap ELSE (max(CASE WHEN r = f THEN rest END) OVER ({part}) * w) // max(CASE WHEN r = f THEN behind END) OVER ({part}) END)::HUGEINT AS given FROM first_{k})",
        ]
    return ", ".join(parts)
