"""Metrics, sketches, fences and verdicts against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from weftgraph.llm import quality
from weftgraph.llm.queries_quality import op9_adaptive_quality

WORD = r"[^\x20\x09-\x0D]+"


def metrics(text):
    t = text or ""
    w = re.findall(WORD, t)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    repeats = {p for places in seen.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeats), "n_lines": len(lines)}


def floor_of(v):
    shift = max(v.bit_length() - quality.BIN.bit_length(), 0)
    return v >> shift << shift


def brute(rows):
    """(doc_id, metrics, base_failed, kept) of (doc_id, text, lang, source), and the fences."""
    found = [metrics(r[1]) for r in rows]
    failed = [m["n_words"] < 50 or m["n_repeat_words"] * 100 > m["n_words"] * 50 for m in found]
    rate = lambda m, r: (m[r.above] + r.plus) * 1000 // (m[r.below] + r.base) if m[r.below] + r.base else None
    verdicts, fences = [not f for f in failed], {}
    for r in quality.RULES:
        groups = defaultdict(list)
        for row, m, f in zip(rows, found, failed):
            if not f:
                for key in ((), (row[2],), (row[2], row[3])):
                    groups[key].append(floor_of(rate(m, r)))
        quarter = lambda v, k: sorted(v)[-(-len(v) * k // 4) - 1]
        drawn = {}
        for key in sorted(groups, key=len):
            own = [quarter(groups[key], k) for k in (1, 3)]
            n, up = len(groups[key]), drawn.get(key[:-1])
            drawn[key] = own if not key else [(n * a + quality.PRIOR * b) // (n + quality.PRIOR) for a, b in zip(own, up)]
        for k, row in enumerate(rows):
            low, high = drawn.get((row[2], row[3]), (None, None))
            if low is not None and not failed[k]:
                fence = high + r.reach * (high - low) if r.upper else low - r.reach * (high - low)
                fences[row[2], row[3], r.name] = fence
                v = rate(found[k], r)
                verdicts[k] &= not (v > fence if r.upper else v < fence)
    return [(r[0], *(m[c] for c in quality.METRICS), f, v) for r, m, f, v in zip(rows, found, failed, verdicts)], fences


def table():
    rng = random.Random(5)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefgé日") for _ in range(rng.randrange(1, size))) for _ in range(n))
    rows = []
    for k in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("fr", "c"), (None, "a"), ("de", None)])
        text = "\n".join(words(rng.randrange(5, 60), 9 if lang == "en" else 14) for _ in range(rng.randrange(1, 9)))
        if k % 10 == 0:
            text += " ###" * rng.randrange(60)
        if k % 11 == 0:
            line = words(12, 6)
            text += f"\n{line}" * rng.randrange(9)
        if k % 13 == 0:
            text += " " + words(40, 60)
        rows.append((k if k % 50 else None, text, lang, source))
    return rows + [rows[1]] * 3 + [(900, None, "en", "a"), (901, "", "en", "a"), (902, " \t\n", "xx", "alone"), (903, words(60, 5), "yy", "few"), (904, words(40_000, 8), "en", "a"), (905, "\x85 \u00a0 x|y<z>", "en", "b")]


def test_query_against_brute_force(spark, tmp_path):
    rows = table()
    wanted, fences = brute(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op9_adaptive_quality(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    beyond = [w for w in wanted if not w[-2] and not w[-1]]
    assert len(beyond) > 20 and len({f for (_, _, r), f in fences.items() if r == "symbol_rate"}) >= 3


def test_sql_gives_the_same(spark, tmp_path):
    import duckdb

    from weftgraph.llm.queries_quality import sql

    rows = [r for r in table() if r[0] != 904]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, con.execute(sql()).fetchall())) == sorted(map(str, brute(rows)[0]))


def test_sketches_add_up(spark):
    rows = spark.createDataFrame([(lang, s, v, False) for lang, s, v in [("en", "a", 5), ("en", "b", 5), ("en", "b", 129), ("fr", "a", 7000)]], "lang string, source string, v long, base_failed boolean")
    rows = rows.select("*", *[F.col("v").alias(r) for r in quality.RATES])
    own = quality.sketches(rows, ("lang", "source"))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(quality.merged(own, ("lang",))) == key(quality.sketches(rows, ("lang",)).select("lang", "rule", "bin", "n"))
    values = spark.range(0, 40000, 37).select("id", quality.from_bin(quality.to_bin(F.col("id"))).alias("b")).collect()
    assert all(r.b == floor_of(r.id) for r in values)


def test_clashing_names_and_empty_table(spark):
    extra = {"t": "1", "w": "2", "row": "3", "kept": "4", "fence_lang": "5", "own_lang": "6", "n_words": "7", "_w": "8", "symbol_rate_fence": "9", "rule": "10", "bin": "11"}
    rows = spark.createDataFrame([("a b c " * 30, "en", "s"), (None, None, None)], "text string, lang string, source string")
    rows = rows.select("*", *[F.lit(v).alias(c) for c, v in extra.items()])
    measured = quality.rates(quality.with_metrics(rows))
    out = quality.judged(measured, quality.thresholds(measured)).collect()
    assert len(out) == 2
    for r in out:
        assert all(r[c] == v for c, v in extra.items() if c not in ("kept", "n_words"))
        assert r.kept is False and r.n_words == (90 if r.text else 0)
    none = quality.rates(quality.with_metrics(rows.limit(0)))
    assert quality.judged(none, quality.thresholds(none)).count() == 0
