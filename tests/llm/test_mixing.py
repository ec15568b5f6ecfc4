"""Budgets on small trees by hand, and the selection by its totals."""

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import mixing
from weftgraph.llm.shared import written

LEAVES = "domain string, lang string, source string, tokens long"


def given(spark, rows, total, weights, epochs=1):
    out = mixing.budgets(spark.createDataFrame(rows, LEAVES), total, weights, epochs).collect()
    return {(r.domain, r.lang, r.source): r.budget for r in out}


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 100), ("b", "en", "s3", 1000)]
    assert given(spark, rows, 100, {}) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 40, ("b", "en", "s3"): 50}


def test_a_full_family_passes_it_up(spark):
    rows = [("a", "en", "s1", 10), ("a", "fr", "s2", 5), ("b", "en", "s3", 1000)]
    assert given(spark, rows, 100, {}) == {("a", "en", "s1"): 10, ("a", "fr", "s2"): 5, ("b", "en", "s3"): 85}


def test_weights_zero_nulls_and_too_much(spark):
    rows = [(None, None, "s1", 10), (None, None, None, 10), ("b", "en", "s3", 30)]
    assert given(spark, rows, 40, {("b",): 3}) == {(None, None, "s1"): 5, (None, None, None): 5, ("b", "en", "s3"): 30}
    assert given(spark, rows, 40, {("b",): 0}) == {(None, None, "s1"): 10, (None, None, None): 10}
    assert given(spark, rows, 1000, {}) == {(None, None, "s1"): 10, (None, None, None): 10, ("b", "en", "s3"): 30}
    assert given(spark, [], 5, {}) == {}


@pytest.mark.parametrize("edge_docs", [2, 1000])
def test_prefix_reaches_the_budget(spark, edge_docs):
    rows = [(i if i % 9 else None, "d", "en" if i < 50 else "fr", "s", i % 7, "x") for i in range(60)] + [(1, "d", "en", "s", 1, "x")] * 3
    docs = written(spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long, epoch string"), "t")
    out = mixing.mixed(docs, (9, 10), {("d", "fr"): 20}, 5, epochs=3, edge_docs=edge_docs)
    total = sum(r[4] for r in rows) * 9 // 10
    got = {r.lang: r for r in out.groupBy("lang").agg(F.sum("taken_tokens").alias("t"), F.max("epoch").alias("e"), F.sum((F.col("taken_tokens") < F.col("tokens")).cast("int")).alias("cut")).collect()}
    assert got["fr"].t == 3 * sum(r[4] for r in rows if r[2] == "fr") and got["fr"].e == 2
    assert got["en"].t == total - got["fr"].t and got["en"].cut <= 1
    assert mixing.mixed(docs.limit(0), (1, 1), {}, 1).count() == 0


def test_equal_rows_null_ids_and_clashing_names(spark):
    names = ["leaf", "place", "full", "rest", "row", "t", "prefix", "before", "bucket", "n", "start", "k", "id", "own_lang", "e", "cap", "w", "budget"]
    rows = [(None, "d", "en", "s", 3, *"x" * len(names))] * 40 + [(None, "d", "en", "s", 3, *f"{k}" * len(names)) for k in range(9)] + [(7, None, None, None, None, *"y" * len(names))]
    docs = written(spark.createDataFrame(rows, f"doc_id long, domain string, lang string, source string, tokens long, {', '.join(f'{n} string' for n in names)}"), "t")
    for share, wanted in (((1, 2), 73), ((1, 147), 1), ((147, 147), 147), ((3, 2), 220)):
        for edge in (1, 500) if share == (1, 2) else (500,):
            out = mixing.mixed(docs, share, {}, 3, edge_docs=edge).collect()
            assert sum(r.taken_tokens for r in out) == wanted and all(r[n] in "x012345678" for r in out for n in names)
            assert sum(r.taken_tokens < 3 for r in out) == (wanted % 3 > 0)
            assert len(out) == -(-wanted // 3)
