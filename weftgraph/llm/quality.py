"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Every document gets rates, each with a pseudo-count above and below, so that a short text doesn't look extreme and
a source in which most texts have none of something still has a spread. A sketch is a histogram over logarithmic
bins with 64 bins an octave (a relative error of 1/64 at most), so sketches of parts of the corpus add up to the
sketch of the whole, and those of the sources of a language to that of the language.

The quartiles of a group are drawn towards those of the group above it, as if PRIOR documents with the quartiles of
the language had been seen in each source, and PRIOR with those of all in each language: with few documents a source
follows its language, with many its own sketch, without a size at which it switches. The fence is the outer
quartile plus (minus) a multiple of the distance between the quartiles; no constant bounds it.

Defined results: a null or empty text has no words and fails the base rules; null language or source form groups of
their own; a document on a fence is kept; equal texts of a source get equal verdicts, repeated rows count as often as
they come; an empty table gives no thresholds and no rows; a group in which all fail the base rules has no fences.
Rows and extra columns pass through, whatever their names; one named as an output is replaced. A very long text is
handled in its row. Everything is DataFrame expressions; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.llm.shared import WORD, words, written

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A rate in thousandths, (above + plus) over (below + base); upper: too much of it is bad. reach: how many
    distances between the quartiles the fence lies behind the outer one."""

    name: str
    above: str
    plus: int
    below: str
    base: int
    upper: bool
    reach: int


#: Symbols per word, repeated lines per line, repeated words per word, length of words (both sides).
RULES = (
    Rule("symbol_rate", "n_symbols", 2, "n_words", 20, True, 6),
    Rule("dup_line_rate", "n_dup_lines", 1, "n_lines", 5, True, 6),
    Rule("repeat_rate", "n_repeat_words", 6, "n_words", 60, True, 9),
    Rule("long_word_rate", "word_chars", 0, "n_words", 0, True, 6),
    Rule("short_word_rate", "word_chars", 0, "n_words", 0, False, 6),
)
RATES = [r.name for r in RULES]
#: Documents that the group above counts for in a group's quartiles.
PRIOR = 100
BIN = 64


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds METRICS and n_lines. One pass over each text, no shuffle.

    Repeats are found from the 64-bit hashes of the 3-word windows; only texts in which a hash comes twice
    sort them with their places.
    """
    outs = [*METRICS, "n_lines"]
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.withColumn("w", words(F.col("t"))).withColumn(
        "h",
        F.when(F.size("w") < 3, F.expr("CAST(array() AS array<bigint>)")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
        ),
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("l", lines).withColumn("unique", F.size(F.array_distinct("h")) == F.size("h"))
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("s", F.when(~F.col("unique"), placed))
    twice = F.filter("s", lambda x, k: F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("p", F.transform(twice, lambda x: x["i"]))
    covered = F.size(F.array_union(F.array_union("p", F.transform("p", lambda p: p + 1)), F.transform("p", lambda p: p + 2)))
    return df.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in outs],
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("unique"), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
    )


def rates(df: DataFrame) -> DataFrame:
    """Adds the rates of RULES, in thousandths (null where there is nothing to divide by), and base_failed."""
    n = F.col("n_words")
    found = {r.name: F.expr(f"({r.above} + {r.plus}) * 1000 div nullif({r.below} + {r.base}, 0)") for r in RULES}
    return df.withColumns(found | {"base_failed": (n < 50) | (F.col("n_repeat_words") * 100 > n * 50)})


def to_bin(v: Column) -> Column:
    """Bin of a non-negative whole number: itself below 2 * BIN, then BIN bins an octave."""
    shift = F.greatest(F.length(F.bin(v)) - BIN.bit_length(), F.lit(0)).cast("int")
    return F.call_function("shiftright", v, shift) + shift * BIN


def from_bin(b: Column) -> Column:
    """The smallest number of a bin."""
    shift = F.greatest(F.floor(b / BIN) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - shift * BIN).cast("long"), shift)


def sketches(measured: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rule, bin, n) of the documents that the fixed base rules leave; partial sums before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("v")) for r in RULES])).alias("x")
    left = measured.filter(~F.col("base_failed")).select(*keys, pairs).filter(F.col("x.v").isNotNull())
    return left.groupBy(*keys, F.col("x.rule").alias("rule"), to_bin(F.col("x.v")).alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds up sketches over all other keys."""
    return sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rule, docs, low, high) from a sketch."""
    by = W.partitionBy(*keys, "rule")
    at = sketch.withColumn("total", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("bin")))
    quarter = lambda k: from_bin(F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin"))))
    return at.groupBy(*keys, "rule").agg(F.max("total").alias("docs"), quarter(1).alias("low"), quarter(3).alias("high"))


def drawn(own: DataFrame, above: DataFrame, keys: tuple[str, ...], prior: int) -> DataFrame:
    """The quartiles of own with those of the group above (same keys but the last), by weight of documents."""
    up = above.select(*[F.col(k).alias(f"up_{k}") for k in keys], F.col("rule").alias("up_rule"), F.col("low").alias("up_low"), F.col("high").alias("up_high"))
    same = own["rule"] == up["up_rule"]
    for k in keys:
        same = same & own[k].eqNullSafe(up[f"up_{k}"])
    mean = lambda c: F.expr(f"CAST((CAST(docs AS decimal(20,0)) * {c} + {prior} * up_{c}) div (CAST(docs AS decimal(20,0)) + {prior}) AS bigint)").alias(c)
    return own.join(up, same).select(*own.columns[: -len(("low", "high"))], mean("low"), mean("high"))


def thresholds(measured: DataFrame, language: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row per language and source: fence_lang, fence_source, and a fence for each rule, named <rule>_fence.

    The size of this table is that of the set of (language, source), not of the corpus.
    """
    named = measured.select(F.col(language).alias("fence_lang"), F.col(source).alias("fence_source"), "base_failed", *RATES)
    own = written(sketches(named, ("fence_lang", "fence_source")), "sketches")
    whole = quartiles(merged(own, ()), ())
    languages = drawn(quartiles(merged(own, ("fence_lang",)), ("fence_lang",)), whole, (), prior)
    sources = drawn(quartiles(own, ("fence_lang", "fence_source")), languages, ("fence_lang",), prior)
    fence = lambda r: F.expr(f"high + {r.reach} * (high - low)" if r.upper else f"low - {r.reach} * (high - low)")
    return sources.groupBy("fence_lang", "fence_source").agg(*[F.max(F.when(F.col("rule") == r.name, fence(r))).alias(f"{r.name}_fence") for r in RULES])


def judged(measured: DataFrame, limits: DataFrame, language: str = "lang", source: str = "source") -> DataFrame:
    """Joins the fences to the documents; adds kept. A group without fences has only the base rules."""
    rows = measured.select(F.struct("*").alias("row"), F.col(language).alias("own_lang"), F.col(source).alias("own_source"))
    df = rows.join(limits, F.col("own_lang").eqNullSafe(F.col("fence_lang")) & F.col("own_source").eqNullSafe(F.col("fence_source")), "left")
    ok = ~F.col("row.base_failed")
    for r in RULES:
        beyond = F.col(f"row.{r.name}") > F.col(f"{r.name}_fence") if r.upper else F.col(f"row.{r.name}") < F.col(f"{r.name}_fence")
        ok = ok & ~F.coalesce(beyond, F.lit(False))
    return df.select(*[F.col("row")[c].alias(c) for c in measured.columns if c != "kept"], ok.alias("kept"))
