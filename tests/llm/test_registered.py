"""Registered queries as a whole against libraries and brute force over a whole table."""

import hashlib
import re

import pandas as pd
import public_tokenizers as P
import tiktoken
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import bpe
from weftgraph.llm.registry import LLM_CATALOG

SF = "/root/testdata/sf0.001"


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").to_dict("records")


def test_op10_against_tiktoken(spark):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = set()
    for r in documents():
        ids = theirs.encode_ordinary(r["text"])
        want.add((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = LLM_CATALOG["op10_bpe_rank_queue"].run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_op3_against_all_pairs(spark):
    marks = {}
    for r in documents():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
        marks[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(marks)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = LLM_CATALOG["op3_simhash_trie"].run(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in got} == {(i, f"{marks[i]:016x}", find(i)) for i in ids} and len(got) == len(ids)


def test_op4_keeps_what_isnt_personal(spark):
    """Rows, lengths of formats and equal texts: what can be said of the query without a second scanner."""
    docs = documents()
    frame = LLM_CATALOG["op4_feistel_pseudonyms"].run(spark, SF)
    got = frame.collect()
    assert sorted(r.doc_id for r in got) == sorted(d["doc_id"] for d in docs)
    same = {}
    for d in docs:
        same.setdefault(d["text"], []).append(d["doc_id"])
    by_id = {r.doc_id: tuple(r[c] for c in frame.columns if c != "doc_id") for r in got}
    assert all(len({by_id[i] for i in ids}) == 1 for ids in same.values())
    assert frame.filter(F.col("doc_id").isNull()).count() == 0
