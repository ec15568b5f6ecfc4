"""Against the tiktoken library, which is the brute force here."""

import base64

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Encoder(RANKS, P.PATTERN)
CASES = ["", " ", "  ", "\n", "a", " a", "a ", "it's we'll  go", "x\n y", "\x1c a\x1d \x85b", "aaaa" * 5000, "日本語 テスト", "é" * 3000, "1 2  3\t\t4 ", "#$%&& **", "ſtrange Σς K", " a b"]


def test_same_ids_as_tiktoken():
    for text in CASES:
        assert OURS.encode(text) == THEIRS.encode_ordinary(text), repr(text[:40])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sl\n\t é1.,#日\x1c"), max_size=60))
def test_same_ids_on_random_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_round_trip_with_nulls_and_clashing_columns(spark):
    rows = [(1, t, 7) for t in CASES] + [(None, None, None), (1, CASES[7], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert r.ids == THEIRS.encode_ordinary(r.text or "")
    assert bpe.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    bad = spark.createDataFrame([([1, None, 99999999],), (None,)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(bad, P.path("byte_bpe_50k.tiktoken")).collect()] == [bytes(next(t for t, i in RANKS.items() if i == 1)), b""]
