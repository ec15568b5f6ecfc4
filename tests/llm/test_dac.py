"""Round trips of the codes, and the query's rows against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from weftgraph.llm import dac
from weftgraph.llm.queries_dac import op5_addressable_codes


def test_random_access():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 256, n), rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        f = dac.File(dac.packed([5, None], np.array([n // 2, n - n // 2]), ids))
        assert f.doc_ids == [5, None] and f.offsets.tolist() == [0, n // 2, n]
        assert f.between(0, n).tolist() == ids.tolist()
        places = rng.integers(0, n, 300) if n else np.array([], int)
        assert f.at(places).tolist() == ids[places].tolist()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert f.between(a, b).tolist() == ids[a:b].tolist()


def test_query_against_the_library(spark, tmp_path):
    texts = ["", None, "Hello  WORLD's\n\tit's 123 x", "<|endoftext|> a", "Ab<|endoftext|>Cd  <|STARTOFTEXT|>", " <|startoftext|>\n", "é é   Σς İ", "日本 語", " lead", "trail ", "á ́b", "word " * 4000, "x" * 3000]
    rows = [(i * 7 % 13, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (3, "again", "x"), (3, "again", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = [], 0
    got = sorted((tuple(r) for r in op5_addressable_codes(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    coded = [(d, own.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows]
    assert sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in coded), key=str) == sorted(((r[0], r[2], r[3]) for r in got), key=str)
    for r in got:
        assert r[1] == start
        start += r[2]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    files = dac.stored(docs, P.path("word_bpe_49k.json"), 2, file_tokens=9)  # files that end early
    assert files.count() > 5
    assert sorted((tuple(r) for r in dac.digests(dac.starts(files)).collect()), key=lambda r: r[1]) == [tuple(r) for r in got]
    again = dac.write(dac.encoded(docs.coalesce(1).sort("doc_id"), P.path("word_bpe_49k.json"), 2), f"file://{tmp_path}/dac")
    assert sorted((r.doc_id, len(r.ids)) for r in dac.read(again).collect() if r.doc_id) == sorted((r[0], r[2]) for r in got if r[0])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op5_addressable_codes(spark, f"{tmp_path}/none").count() == 0


def test_random_texts_and_settings(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "c", " ", "  ", "\n", "'s", "!", ".,", "É", "日", "7", "<|endoftext|>", "<|", "endoftext", "|>"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    for as_text in (False, True):
        own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        own.encode_special_tokens = as_text
        ends, flat = dac.Pieces(P.path("word_bpe_49k.json"), as_text).lists(pa.array([*texts, None]), 2)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [own.encode(t, add_special_tokens=False).ids + [2] for t in [*texts, ""]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in dac.encoded(df, P.path("word_bpe_49k.json"), None).collect()}
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert rows == {k: own.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}
