"""Against runs found by comparing words one by one."""

import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

from weftgraph.llm import runs
from weftgraph.llm.queries_runs import op13_periodic_runs


def plain(words, least=6, times=4):
    found = []
    for q in range(1, len(words) + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            if end > start and length >= max(least, times * q):
                part = words[start : start + length]
                if not any(all(part[i] == part[i + d] for i in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            start = max(end, start + 1)
    return sorted(found)


def row_of(doc_id, text):
    """The contract's row, by way of `plain`."""
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    rest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), *rest, sha256(lines.encode()).hexdigest(), sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def texts_of(rng, n):
    out = []
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(1, 90):
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            words += unit * rng.choice([1, 1, 2, 4, 5, 9]) + unit[: rng.randrange(len(unit))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t\v", "\x1c "]) for w in words))
    return out


def test_runs_against_plain_version():
    rng = random.Random(5)
    for text in texts_of(rng, 400):
        words = runs.words_of(text)
        assert runs.runs(words) == plain(words), words
        assert runs.runs(words, 2, 2) == plain(words, 2, 2), words
    for n in range(14):
        assert runs.runs([b"x"] * n) == plain([b"x"] * n)


def test_query_against_plain_version(spark, tmp_path):
    rng = random.Random(6)
    texts = texts_of(rng, 150) + ["", None, " \n", "a", "a " * 6, "a b " * 4, "é\xa0é " * 9, "\x85 " * 8, "word " * 300, "x y z " * 60 + "end", " ".join(map(str, range(300)))]
    rows = [(i * 37, t, "s", 1) for i, t in enumerate(texts)] + [(None, "a " * 9, "s", 1), (37, texts[1], "s", 1), (37, texts[1], "s", 1), (-5, "b " * 7, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, best int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((row_of(d, t) for d, t, *_ in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 40 and sum(crc32(str(d).encode()) % 10 == 0 for d, *_ in rows) > 8
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_long_texts():
    rng = random.Random(7)
    page = [str(rng.randrange(3000)).encode() for _ in range(9000)]
    words = [str(rng.randrange(9000)).encode() for _ in range(20000)] + page * 5 + [b"end"] + [b"x"] * 30000
    found = runs.runs(words)
    assert (20000, 45000, 9000) in found and found[-1] == (65001, 30000, 1) and runs.best(found) == (65001, 30000, 1)
