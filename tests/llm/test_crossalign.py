"""Against whole texts tokenised by both libraries and aligned offset by offset."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers as P
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from weftgraph.llm import crossalign
from weftgraph.llm.queries_crossalign import op11_segment_alignment

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True


def byte_of():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in printable):
        table[chr(256 + k)] = b
    return table


BYTE = byte_of()


def plain(text):
    """(ids of a, ids of b, groups of numbers of tokens), or None."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    left = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    right = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(left) == b"".join(right) == (" " + text).encode():
        return None
    ends = [{}, {}]
    for k, tokens in enumerate((left, right)):
        at = 0
        for n, t in enumerate(tokens):
            at += len(t)
            ends[k][at] = n + 1
    cuts = sorted(ends[0].keys() & ends[1].keys())
    groups, i, j = [], 0, 0
    for c in cuts:
        groups.append((a[i : ends[0][c]], b[j : ends[1][c]]))
        i, j = ends[0][c], ends[1][c]
    return a, b, groups


def brute(rows):
    done = [(d, plain(t)) for d, t in rows]
    counts = Counter()
    for _, p in done:
        counts.update({(x, y) for left, right in p[2] for x in left for y in right} if p else ())
    most = defaultdict(int)
    for (x, _), c in counts.items():
        most[x] = max(most[x], c)
    for d, p in done:
        if not p:
            yield (d, 0, 0, 0, 0, 0, 0, "")
            continue
        links = [(x, y) for left, right in p[2] for x in left for y in right]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in p[2])
        yield (d, len(p[0]), len(p[1]), len(p[2]), len(links), sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links), sha256(shown.encode()).hexdigest())


CASES = [
    "", None, " ", "  ", "a", " a ", "a  b   c", "\n", "\na\n\nb \n c\t", "x\r\ny\r", "end. Next▁word", "▁", "<|endoftext|> a <s> </s>", "it's we'll\x0bgo\x0c", "a\x1cb \x1d c", "café 日本語 テスト ①②",
    "a\xa0b　c   d", "x\x00y z", "﻿head", "a" * 3000, "word " * 2000, "{\r\n  return x;\r\n}", "#### *** $$ 12345 6,789.01", "\x85 next", "tail \t \n",
]


def test_cuts_are_checked():
    two = crossalign.Two(A_PATH, B_PATH)
    assert " " in two.cuts and "\n" in two.cuts and "\r" not in two.cuts
    rng = random.Random(9)
    for text in CASES + ["".join(rng.choice(["a", "the", " ", "  ", "\n", "\r", "\t", "\xa0", "."]) for _ in range(30)) for _ in range(300)]:
        if text:
            parts = two.segments(" " + text)
            assert "".join(parts) == " " + text and all(p[0] in two.cuts for p in parts)
            packed = two.aligned(parts)
            whole = plain(text)
            if whole is None:
                assert b"" in packed
                continue
            found = crossalign.Parts(pa.array(packed, pa.large_binary()))
            assert found.a.tolist() == whole[0] and found.b.tolist() == whole[1], repr(text[:50])
            assert [(x, y) for x, y in zip(found.in_a, found.in_b)] == [(len(x), len(y)) for x, y in whole[2]]
            assert found.links.tolist() == [x << 32 | y for left, right in whole[2] for x in left for y in right]


def test_wide_numbers():
    two = crossalign.Two(A_PATH, B_PATH)
    parts = [" a", " " + "xyz-" * 30000, " ▁", "\nb"]
    packed = [two.aligned([p])[0] for p in parts]
    assert packed[1].startswith(crossalign.MARK) and packed[2] == b""
    found = crossalign.Parts(pa.array(packed, pa.large_binary()))
    assert found.valid.tolist() == [True, True, False, True]
    assert found.a.tolist() == [i for p in (parts[0], parts[1], parts[3]) for i in A.encode(p, add_special_tokens=False).ids]
    assert found.n_a[1] > 65535


def test_query_against_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "cat", "tokeniser", "unhappy", "1999", "--", "(x)", "naïve", "Wörter", "q"]
    texts = CASES + [rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", "\n", ", ", "  ", ""]) for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(i * 3, t, "x", None) for i, t in enumerate(texts)] + [(None, "no id here", "x", 1), (3, "the cat", "x", 1), (3, "the cat", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, segment string, codes int").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(brute([(d, t) for d, t, *_ in rows]), key=str)
    assert sorted((tuple(r) for r in op11_segment_alignment(spark, str(tmp_path)).collect()), key=str) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    small = crossalign.align(docs, A_PATH, B_PATH, size=500).select("doc_id", *crossalign.SUMS).collect()  # many blocks
    assert sorted(map(tuple, small), key=str) == sorted((r[:-1] for r in want), key=str)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op11_segment_alignment(spark, f"{tmp_path}/none").count() == 0
