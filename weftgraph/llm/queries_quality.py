"""Query of operator 9."""

from __future__ import annotations

from weftgraph.catalog import Catalog
from weftgraph.llm import quality
from weftgraph.llm.shared import written

CATALOG = Catalog()
SPACE = r"[^\x20\x09-\x0D]"


def sql(rules=quality.RULES, prior: int = quality.PRIOR, size: int = quality.BIN) -> str:
    """The metrics by unnesting all windows, and the fences in whole numbers."""
    found = ", ".join(f"({r.above} + {r.plus}) * 1000 // nullif({r.below} + {r.base}, 0) AS {r.name}" for r in rules)
    shift, back = f"greatest(length(bin(v)) - {size.bit_length()}, 0)", f"greatest(bin // {size} - 1, 0)"
    quarter = lambda k: f"min(CASE WHEN upto * 4 >= total * {k} THEN (bin - {back} * {size}) * pow(2, {back})::BIGINT END)"
    parts, levels = [], (("root", ""), ("languages", "lang, "), ("sources", "lang, source, "))
    for name, keys in levels:
        inside = f"SELECT {keys}rule, bin, sum(sum(n)) OVER (PARTITION BY {keys}rule) AS total, sum(sum(n)) OVER (PARTITION BY {keys}rule ORDER BY bin) AS upto FROM sketch GROUP BY {keys}rule, bin"
        parts.append(f"q_{name} AS (SELECT {keys}rule, max(total) AS docs, {quarter(1)} AS low, {quarter(3)} AS high FROM ({inside}) GROUP BY {keys}rule)")
    mean = lambda c: f"((o.docs * o.{c} + {prior} * u.{c}) // (o.docs + {prior}))::BIGINT AS {c}"
    parts.append(f"d_languages AS (SELECT o.lang, o.rule, {mean('low')}, {mean('high')} FROM q_languages o JOIN q_root u USING (rule))")
    parts.append(f"d_sources AS (SELECT o.lang, o.source, o.rule, {mean('low')}, {mean('high')} FROM q_sources o JOIN d_languages u ON o.rule = u.rule AND o.lang IS NOT DISTINCT FROM u.lang)")
    cases = " ".join(f"WHEN '{r.name}' THEN {'high +' if r.upper else 'low -'} {r.reach} * (high - low)" for r in rules)
    parts.append(f"fences AS (SELECT lang, source, rule, CASE rule {cases} END AS fence FROM d_sources)")
    upper = ", ".join(f"'{r.name}'" for r in rules if r.upper)
    return f"""WITH w AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACE}+') AS w FROM documents),
 wins AS (SELECT k, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS g, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
 twice AS (SELECT k, g FROM wins GROUP BY k, g HAVING count(*) > 1),
 reps AS (SELECT k, count(DISTINCT p) AS c FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM wins JOIN twice USING (k, g)) GROUP BY k),
 m AS (SELECT w.k, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACE}')) AS l, coalesce(c, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN reps ON w.k = reps.k),
 n AS (SELECT * EXCLUDE (l), len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m),
 r AS (SELECT *, {found} FROM n), v AS (UNPIVOT r ON {', '.join(x.name for x in rules)} INTO NAME rule VALUE v),
 sketch AS (SELECT lang, source, rule, (v >> {shift}) + {shift} * {size} AS bin, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL), {", ".join(parts)},
 bad AS (SELECT DISTINCT k FROM v JOIN fences f ON v.rule = f.rule AND v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source WHERE CASE WHEN v.rule IN ({upper}) THEN v > fence ELSE v < fence END)
 SELECT doc_id, {', '.join(quality.METRICS)}, base_failed, NOT base_failed AND bad.k IS NULL AS kept FROM n LEFT JOIN bad USING (k)"""


@CATALOG.add("op9_adaptive_quality", sql=sql(), covers="llm 9")
def op9_adaptive_quality(spark, sf_dir):
    """Verdicts on all whole documents by fences per language and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = quality.rates(quality.with_metrics(docs)).select("doc_id", "lang", "source", *quality.METRICS, *quality.RATES, "base_failed")
    rows = written(rows, "quality")  # thresholds and verdicts both read them
    limits = written(quality.thresholds(rows), "fences")  # as a file its size is known, so a small one is broadcast
    return quality.judged(rows, limits).select("doc_id", *quality.METRICS, "base_failed", "kept")
