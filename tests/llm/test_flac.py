"""Round trips, damage, seeking, and the query against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import flac
from weftgraph.llm.queries_media import op8_flac

RNG = random.Random(4)
PAYLOADS = [b"\0" * 64, bytes(range(256)), b"abc " * 16, RNG.randbytes(64 * 40), "Die Straße ñ é. ".encode() * 1000, bytes([0, 255] * 320), b"a" * 1024 + RNG.randbytes(64), b"the quick brown fox " * 16 * 60, b"\x80" * 500 + bytes([0]) * 12, (128 + 90 * np.sin(np.arange(6400) / 9)).astype(np.uint8).tobytes()]


def test_round_trip():
    streams = flac.encode(PAYLOADS)
    got = flac.decode(streams)
    assert [g[0] for g in got] == PAYLOADS
    assert all(b == list(range(0, len(p), flac.BLOCK)) for (_, b), p in zip(got, PAYLOADS))
    assert len(streams[-1]) < 0.7 * len(PAYLOADS[-1]) and [flac.encode([p])[0] for p in PAYLOADS] == streams


def test_without_seek_table():
    s = flac.encode([PAYLOADS[-1]])[0]
    samples, _, points, at = flac._metadata(s)
    bare = s[:4] + bytes([0x80]) + s[5:42] + s[at:]
    assert flac.decode([bare]) == flac.decode([s]) and samples == len(PAYLOADS[-1]) and len(points) > 1


def test_partitions_and_long_runs():
    """A frame written bit by bit here: fixed order 1, four partitions, residuals with long zero runs."""
    samples = [0] * 16 + [-128, 127] * 8 + [1] * 16 + [5, 5, 5, 5] * 4
    ks = [0, 1, 2, 0]
    bits = f"{9 << 1:08b}" + f"{samples[0] & 255:08b}" + "00" + "0010"
    for p in range(4):
        bits += f"{ks[p]:04b}"
        for t in range(16 * p or 1, 16 * p + 16):
            r = samples[t] - samples[t - 1]
            u = 2 * r if r >= 0 else -2 * r - 1
            bits += "0" * (u >> ks[p]) + "1" + (f"{u & ((1 << ks[p]) - 1):0{ks[p]}b}" if ks[p] else "")
    bits += "0" * (-len(bits) % 8)
    head = flac.frame_header(0, 64)
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    body += int(flac.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]).to_bytes(2, "big")
    x, n, number, ends = flac.decode_frames(np.frombuffer(body, np.uint8), np.array([0]))
    assert x[:, 0].tolist() == samples and n[0] == 64 and number[0] == 0 and ends[0] == len(body)


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2**21 - 1, 2**21, 2**30):
        h = flac.frame_header(n, 64)
        assert flac._read_header(h) == (n, 64) and len(h) == 7 + flac._number_bytes(h[4])


@pytest.mark.parametrize("where", [30, 60, -1, -100])
def test_damage_is_found(where):
    s = bytearray(flac.encode([PAYLOADS[4]])[0])
    s[where] ^= 4
    with pytest.raises((ValueError, IndexError, OverflowError)):
        flac.decode([bytes(s)])


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 32, "x" * 64, "text " * 3000, "a", "\0" * 700]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_flac(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        media = flac.encode([p])[0]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op8_flac(spark, f"{tmp_path}/none").count() == 0
