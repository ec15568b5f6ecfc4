"""Against the tokenizers library."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import merge_rounds
from weftgraph.llm.queries_merge_rounds import op12_merge_rounds

PATH = P.path("word_bpe_49k.json")
THEIRS, OURS = Tokenizer.from_file(PATH), merge_rounds.Encoder(PATH)
CASES = ["", " ", "  ", "\n", "Hello  WORLD's\n\tit's 123 x", "<|endoftext|> a", "Ab<|endoftext|>Cd  <|STARTOFTEXT|>", " <|startoftext|>\n<|endoftext|>", "é é   Σς İ K", "日本 語", "á ́b é", "\x1c a\x1d \x85b c", "x" * 3000, "ab" * 999, "!?" * 700, "<|endof text|>", "👍🏽 İ", "word " * 4000]


def same(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids, repr(text[:60])
    return ids


def test_same_ids_as_the_library():
    for text in CASES:
        same(text)
    ends, flat = OURS.batch(pa.array([*CASES, None, "again"]))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [THEIRS.encode(t, add_special_tokens=False).ids for t in [*CASES, "", "again"]]
    plain, own = merge_rounds.Encoder(PATH, True), Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    for text in CASES:
        assert plain.encode(text) == own.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "the", "in", " ", "  ", "\n", "'s", "!", ".,", "É", "日", "7", "<|endoftext|>", "|>", "\x1f", "　"]), max_size=25).map("".join))
def test_same_ids_on_random_texts(text):
    same(text)


def test_long_words():
    rng = random.Random(3)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aaaaab", "lo", "éà日a", "!.-_"):
        for n in (200, 257, 900, 20000):
            same("".join(rng.choice(letters) for _ in range(n)))
    same("the" * 40000)


def test_query_against_the_library(spark, tmp_path):
    rng = random.Random(4)
    texts = CASES + ["".join(rng.choice(["ab", "c", " ", "\n", "'ll", "É", "9"]) for _ in range(rng.randrange(40))) for _ in range(100)]
    rows = [(i * 7 % 120, t, "x", 1) for i, t in enumerate(texts)] + [(None, None, "x", 1), (3, CASES[4], None, 1), (3, CASES[4], None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, *_ in rows:
        ids = THEIRS.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in op12_merge_rounds(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = merge_rounds.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH)
    assert whole.columns == ["doc_id", "text", "ids", "decoded"] and whole.count() == len(rows)
    odd = spark.createDataFrame([([1, None, 99999999, 49407],), (None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded).decode() for r in merge_rounds.decode(odd, PATH).collect()] == [THEIRS.decode([1, 49407], skip_special_tokens=False), "", ""]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_merge_rounds(spark, f"{tmp_path}/none").count() == 0
