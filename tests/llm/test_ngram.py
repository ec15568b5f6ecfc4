"""Against a dictionary version of the same model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import ngram
from weftgraph.llm.queries_ngram import op2_kneser_ney
from weftgraph.llm.registry import LLM_CATALOG


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Brute:
    def __init__(self, texts, order):
        self.order = order
        self.plain = Counter(t for x in texts for t in toks(x))
        counts = {n: Counter() for n in range(1, order + 1)}
        for x in texts:
            w = ["<s>", *toks(x)]
            for i in range(1, len(w)):
                gram = tuple(w[max(0, i - order + 1) : i + 1])
                counts[len(gram)][gram] += 1
        for n in range(order, 1, -1):
            for g in counts[n]:
                counts[n - 1][g[1:]] += 1
        self.counts = counts
        self.d = {n: ngram.discounts(*[sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
        self.after = {n: defaultdict(list) for n in counts}
        for n in counts:
            for g, c in counts[n].items():
                self.after[n][g[:-1]].append(c)

    def p(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / (len(self.plain) + 1)
        found = self.after[n].get(gram[:-1])
        if not found:
            return lower
        d = lambda c: self.d[n][min(c, 3) - 1] if c else 0
        c = self.counts[n].get(gram, 0)
        return (max(c - d(c), 0) + sum(d(x) for x in found) * lower) / sum(found)

    def score(self, text):
        w = ["<s>", *toks(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(w)))


@pytest.mark.parametrize("order,sorted_at", [(1, 10**6), (2, 10**6), (2, 5), (3, 40), (4, 10**6)])
def test_query(spark, tmp_path, monkeypatch, order, sorted_at):
    monkeypatch.setattr(ngram, "SORTED", sorted_at)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c D é the The of x1 x2 x3".split()) for _ in range(rng.randrange(12))) for _ in range(120)]
    texts += [None, "", " \t", "the\x0bof\x1cz", "new words only here", texts[0], texts[0]]
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3).write.parquet(path)
    out = {r.doc_id: r for r in op2_kneser_ney(spark, str(tmp_path), order).collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [t for d, t, _ in rows if not held(d)]
    model = Brute(train, order)
    n, v = sum(model.plain.values()), len(model.plain)
    assert len(out) == len(rows)
    for d, t, _ in rows:
        r, w = out[d], toks(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(model.plain[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((model.plain[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(model.score(t), rel=1e-9)
    # a distribution: everything that may follow a context, the unknown word included, sums to one
    for context in [(), ("<s>",), ("the",), ("never",)][: order]:
        total = sum(model.p((*context, w)) for w in [*model.plain, "<unk>"])
        assert total == pytest.approx(1)


def test_registered_order_and_large_counts(spark, tmp_path):
    """The query as registered looks two words back, and counts beyond a byte are kept."""
    texts = ["a x b"] * 300 + ["c x d"] * 290 + ["c x b", "x d", "q x b c x d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    model = Brute([t for d, t in enumerate(texts) if not held(d)], 3)
    for r in LLM_CATALOG["op2_kneser_ney"].run(spark, str(tmp_path)).collect():
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-9)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op2_kneser_ney(spark, str(tmp_path)).count() == 0
    folder = ngram.train(spark.createDataFrame([], "text string"), 2)
    assert ngram.scored(spark.createDataFrame([("a b",)], "text string"), folder).first().score == 0.0


def test_counts_beyond_32_bits():
    counts = np.array([1, 300, 5_000_000_000, 2**40], np.int64)
    words = np.arange(4, dtype=np.uint64)
    (got,), back = ngram._unblob(ngram._blob([words], counts))
    assert got.tolist() == words.tolist() and back.tolist() == counts.tolist()
    heads, back = ngram._unblob(ngram._blob([words, words[::-1].copy()], counts))
    assert back.tolist() == counts.tolist()
    data, at = ngram._small(counts), 0

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    assert ngram.Small(take, 4)[np.array([3, 2, 1, 0, 2])].tolist() == [2**40, 5_000_000_000, 300, 1, 5_000_000_000]


def test_a_lost_shard_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "b c a")], "doc_id long, text string")
    folder = ngram.train(docs, 2, f"file://{tmp_path}/model", shard_bytes=4)
    want = sorted(map(tuple, ngram.scored(docs, folder).collect()))
    assert len(want) == 2
    files = sorted((tmp_path / "model").glob("order1-*.kn"))
    assert 1 < len(files)
    files[0].unlink()
    with pytest.raises(Exception, match="order1"):
        ngram.scored(docs, folder).collect()
