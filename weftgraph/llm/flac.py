"""FLAC for 8-bit mono: an encoder, and a decoder that checks every checksum.

Both work on many frames at once: frames lie beside each other as columns, and one step of a loop handles
the same sample of all of them. The seek table has a point for every frame, so the decoder knows where each
begins; in a stream without one the frames are decoded one after another.

Decoded: constant, verbatim, fixed (orders 0 to 4) and linear predictors (orders 1 to 32), Rice residuals
in any number of partitions. A wrong frame or header checksum, a wrong MD5 or a sample count that differs
raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

BLOCK = 512  # samples of a frame
TOGETHER = 2048  # frames handled at once
RATE = 8000
LPC_ORDER, PRECISION, SHIFT = 4, 9, 7
SUBFRAME_LPC, SUBFRAME_FIXED, SUBFRAME_VERBATIM, SUBFRAME_CONSTANT = 32, 8, 1, 0
#: The fixed predictors as coefficients on the samples before.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ polynomial, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each of the slices, a byte of all of them at a time; the longest come first, so the loop's front shrinks."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(order), np.uint32)
    if len(order):
        active = len(left) - np.searchsorted(left[::-1], np.arange(1, left[0] + 1), "left")
        for k, n in enumerate(active):
            c = crc[:n]
            crc[:n] = CRC16[(c >> 8) ^ buffer[at[:n] + k]] ^ (c << 8 & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in the extended UTF-8 of the format."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x3F
    while n > limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
    return bytes([(0xFF << (7 - len(tail)) & 0xFF) | n, *reversed(tail)])


@lru_cache(65536)
def frame_header(number: int, n: int) -> bytes:
    body = b"\xff\xf8" + bytes([0x70, 0x02]) + _coded_number(number) + struct.pack(">H", n - 1)
    return body + bytes([crc8(body)])


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _lpc(x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Quantised coefficients [order, frames] by Levinson's recursion on all frames at once."""
    f = np.where(live, x, 0).astype(np.float64)
    auto = np.stack([np.einsum("tf,tf->f", f[k:], f[: len(f) - k]) for k in range(LPC_ORDER + 1)])
    error = auto[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((LPC_ORDER, x.shape[1]))
    for i in range(LPC_ORDER):
        k = (auto[i + 1] - (a[:i] * auto[i:0:-1]).sum(axis=0)) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top - 1, top).astype(np.int32)


def _residuals(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """x[t] minus its prediction; the first rows, as many as the order, are meaningless."""
    out = x.copy()
    order = len(coefficients)
    if order:
        pred = np.zeros_like(x[order:])
        for j in range(order):
            pred += coefficients[j] * x[order - 1 - j : len(x) - 1 - j]
        out[order:] -= pred >> shift
    return out


def encode_frames(payload: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes in bytes) of the frames payload[starts:starts + sizes], sizes up to BLOCK."""
    n_max, frames = int(sizes.max()), len(starts)
    t = np.arange(n_max)[:, None]
    live = t < sizes
    raw = payload[np.minimum(starts + t, len(payload) - 1)]
    x = np.where(live, raw.astype(np.int32) - 128, 0)
    lpc = _lpc(x, live)
    best = 8 * sizes.astype(np.int64)
    kind, order, param = np.full(frames, SUBFRAME_VERBATIM), np.zeros(frames, np.int64), np.zeros(frames, np.int64)
    folded = np.zeros_like(x)
    for o, coefficients, shift, is_lpc in [(o, np.array(FIXED[o])[:, None], 0, False) for o in range(3)] + [(LPC_ORDER, lpc, SHIFT, True)]:
        u = np.where(live & (t >= o), _fold(_residuals(x, coefficients, shift)), 0)
        count = np.maximum(sizes - o, 0)
        mean = u.sum(axis=0, dtype=np.int64) / np.maximum(count, 1)
        k = np.floor(np.log2(np.maximum(mean * 0.6931, 1))).astype(np.int32)
        fixed_bits = o * 8 + 10 + (9 + o * PRECISION if is_lpc else 0)
        bits = [(u >> (k + d)).sum(axis=0, dtype=np.int64) + count * (k + d + 1) + fixed_bits for d in (0, 1)]
        k, bits = k + (bits[1] < bits[0]), np.minimum(*bits)
        better = (bits < best) & (sizes > o) & (k < 15)
        best = np.where(better, bits, best)
        kind = np.where(better, (SUBFRAME_LPC + o - 1) if is_lpc else SUBFRAME_FIXED + o, kind)
        order, param = np.where(better, o, order), np.where(better, k, param)
        np.copyto(folded, u, where=better)
    same = (np.where(live, raw, raw[0]) == raw[0]).all(axis=0)
    kind = np.where(same, SUBFRAME_CONSTANT, kind)
    rice, is_lpc = kind >= SUBFRAME_FIXED, kind >= SUBFRAME_LPC
    order, param = np.where(rice, order, 0), np.where(rice, param, 0).astype(np.int32)
    # each sample is a code: `used` bits of `value`, zeros before them up to `length`
    coded = live & (t >= order) & rice
    plain = live & ((rice & (t < order)) | (kind == SUBFRAME_VERBATIM) | (same & (t == 0)))
    length = np.where(coded, (folded >> param) + 1 + param, np.where(plain, 8, 0))
    value = np.where(coded, (folded & ((1 << param) - 1)) | (1 << param), x & 0xFF)
    used = np.where(coded, param + 1, np.where(plain, 8, 0)).astype(np.int8)
    heads = [frame_header(int(a), int(b)) for a, b in zip(numbers, sizes, strict=True)]
    head_bytes = np.fromiter(map(len, heads), np.int64, frames)
    between = np.where(rice, 10, 0) + np.where(is_lpc, 9 + LPC_ORDER * PRECISION, 0)
    bits = head_bytes * 8 + 8 + length.sum(axis=0) + between
    out_sizes = (bits + 7) // 8 + 2
    begins = np.cumsum(out_sizes) - out_sizes
    stream = np.zeros(int(out_sizes.sum()) * 8, np.uint8)
    body = begins * 8 + head_bytes * 8 + 8
    ends = np.cumsum(length, axis=0, dtype=np.int64) + body + np.where(t >= order, between, 0)
    for b in range(int(used.max())):
        some = used > b
        stream[ends[some] - 1 - b] = value[some] >> b & 1

    def field(at: np.ndarray, values: np.ndarray, width: int) -> None:
        for b in range(width):
            stream[at + width - 1 - b] = values >> b & 1

    field(body - 8, kind << 1, 8)
    w = np.flatnonzero(is_lpc)
    at = body[w] + order[w] * 8
    field(at, np.full(len(w), (PRECISION - 1) << 5 | SHIFT), 9)
    for j in range(LPC_ORDER):
        field(at + 9 + j * PRECISION, lpc[j, w] & ((1 << PRECISION) - 1), PRECISION)
    w = np.flatnonzero(rice)
    field(body[w] + order[w] * 8 + between[w] - 10, param[w], 10)
    out = np.packbits(stream)
    flat, sized = np.frombuffer(b"".join(heads), np.uint8), np.cumsum(head_bytes) - head_bytes
    out[np.repeat(begins - sized, head_bytes) + np.arange(len(flat))] = flat
    check = crc16(out, begins, out_sizes - 2)
    out[begins + out_sizes - 2], out[begins + out_sizes - 1] = check >> 8, check & 0xFF
    return out, out_sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """A whole FLAC stream of each payload, whose bytes are its samples plus 128."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    data = np.frombuffer(b"".join(payloads), np.uint8)
    frames = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
    starts = (np.cumsum(sizes) - sizes)[of] + number * BLOCK
    lengths = np.minimum(BLOCK, sizes[of] - number * BLOCK)
    parts, framed = [], []
    for k in range(0, len(of), TOGETHER):
        some = slice(k, k + TOGETHER)
        got, n = encode_frames(data, starts[some], lengths[some], number[some])
        parts.append(got.tobytes())
        framed.append(n)
    body, frame_sizes = b"".join(parts), np.concatenate([*framed, np.zeros(0, np.int64)]).astype(np.int64)
    bounds, ends = np.cumsum(np.concatenate([[0], frames])), np.concatenate([[0], np.cumsum(frame_sizes)])
    out = []
    for k, payload in enumerate(payloads):
        a, b = int(bounds[k]), int(bounds[k + 1])
        own = frame_sizes[a:b]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        low, high = (int(own.min()), int(own.max())) if b > a else (0, 0)
        info = struct.pack(">HH", BLOCK, BLOCK) + low.to_bytes(3, "big") + high.to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(b - a, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        points["sample"], points["byte"], points["n"] = number[a:b] * BLOCK, ends[a:b] - ends[a], lengths[a:b]
        seek = points.tobytes()
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + body[int(ends[a]) : int(ends[b])])
    return out


@lru_cache(65536)
def _read_header(head: bytes) -> tuple[int, int]:
    """(frame number, samples) of a header whose bytes are whole."""
    if head[:2] != b"\xff\xf8" or head[2] != 0x70 or head[3] != 0x02:
        raise ValueError("a frame header that this decoder doesn't know")
    if crc8(head[:-1]) != head[-1]:
        raise ValueError("wrong checksum of a frame header")
    number = head[4] if len(head) == 8 else head[4] & (0x7F >> (len(head) - 7))
    for b in head[5:-3]:
        number = number << 6 | b & 0x3F
    return number, struct.unpack(">H", head[-3:-1])[0] + 1


def _number_bytes(first: int) -> int:
    return 1 if first < 0x80 else 8 - (~first & 0xFF).bit_length()


class Bits:
    """Reads at many bit positions of a buffer at once."""

    def __init__(self, buffer: np.ndarray):
        padded = np.concatenate([buffer, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(buffer) + 8
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + n] << np.uint64(56 - 8 * k)

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits at least from each position, at the top of a word."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """`width` bits (1 to 57) as whole numbers."""
        return (self.window(at) >> np.uint64(1) >> (np.uint64(63) - np.asarray(width, np.uint64))).astype(np.int64)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(folded values, positions behind them)."""
        top = (self.window(at) >> np.uint64(11)).astype(np.float64)
        q = 52 - ((top.view(np.int64) >> 52) - 1023)
        far = q > 40
        if far.any():  # long runs of zeros, or a window without a one
            q = q.copy()
            for f in np.flatnonzero(far):
                p, zeros = int(at[f]), 0
                while not (w := int(self.window(np.array([p + zeros]))[0]) >> 11):
                    zeros += 53
                    if p + zeros > 8 * len(self.words):
                        raise ValueError("a residual without an end")
                q[f] = zeros + 53 - w.bit_length()
            low = self.take(at + q + 1, np.maximum(k, 1)) * (k > 0)
        else:
            shifted = self.window(at) << (q + 1).astype(np.uint64)
            low = (shifted >> np.uint64(1) >> (np.uint64(63) - k.astype(np.uint64))).astype(np.int64)
        return q << k | low, at + q + 1 + k


def decode_frames(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples [time, frames], samples of each, numbers, ends in bytes) of the frames that begin at starts."""
    frames = len(starts)
    raw = buffer.tobytes()
    heads = [raw[s : s + 7 + _number_bytes(raw[s + 4])] for s in starts.tolist()]
    number, n = (np.array(v, np.int64) for v in zip(*map(_read_header, heads), strict=True))
    at = (starts + np.fromiter(map(len, heads), np.int64, frames)) * 8
    bits = Bits(buffer)
    kind = bits.take(at, 7)
    if (bits.take(at + 7, 1) != 0).any():
        raise ValueError("wasted bits are not used for 8-bit samples")
    at = at + 8
    lpc, fixed = kind >= SUBFRAME_LPC, (kind >= SUBFRAME_FIXED) & (kind <= SUBFRAME_FIXED + 4)
    verbatim, constant = kind == SUBFRAME_VERBATIM, kind == SUBFRAME_CONSTANT
    if not (lpc | fixed | verbatim | constant).all():
        raise ValueError("a reserved kind of subframe")
    order = np.where(lpc, kind - SUBFRAME_LPC + 1, np.where(fixed, kind - SUBFRAME_FIXED, np.where(constant, 1, 0)))
    most, longest = int(order.max()), int(n.max())
    x = np.zeros((longest, frames), np.int64)
    for j in range(most):
        some = order > j
        x[j, some] = (bits.take(at[some] + 8 * j, 8) ^ 128) - 128
    w = np.flatnonzero(verbatim)
    if len(w):
        t = np.arange(longest)[:, None]
        x[:, w] = np.where(t < n[w], (buffer[np.minimum((at[w] >> 3) + t, len(buffer) - 1)].astype(np.int64) ^ 128) - 128, 0)
    at = at + 8 * np.where(verbatim, n, order)
    coefficients, shift = np.zeros((max(most, 1), frames), np.int64), np.zeros(frames, np.int64)
    for o in range(min(most, 4) + 1):
        for j, c in enumerate(FIXED[o]):
            coefficients[j, fixed & (order == o)] = c
    coefficients[0, constant] = 1
    w = np.flatnonzero(lpc)
    if len(w):
        width = bits.take(at[w], 4) + 1
        shift[w] = bits.take(at[w] + 4, 5)
        at[w] += 9
        for j in range(int(order[w].max())):
            some = order[w] > j
            v, p = w[some], width[some]
            got = bits.take(at[v], p)
            coefficients[j, v] = got - ((got >> (p - 1)) << p)
            at[v] += p
    w = np.flatnonzero(lpc | fixed)
    residual = np.zeros((longest, len(w)), np.int64)
    if len(w):
        if (bits.take(at[w], 2) != 0).any():
            raise ValueError("only 4-bit Rice parameters are read")
        parts = bits.take(at[w] + 2, 4)
        by = np.argsort(-(n[w] - order[w]), kind="stable")
        w, parts = w[by], parts[by]
        place, count, part = at[w] + 6, n[w] - order[w], n[w] >> parts
        border, k = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        active = len(count) - np.searchsorted(count[::-1], np.arange(1, int(count[0]) + 1), "left")
        next_border = 0
        for i, m in enumerate(active):
            if i == next_border:
                new = np.flatnonzero(border[:m] == i)
                k[new] = bits.take(place[new], 4)
                if (k[new] == 15).any():
                    raise ValueError("unencoded residuals are not read")
                place[new] += 4
                border[new] = np.where(border[new] == 0, part[new] - order[w[new]], border[new] + part[new])
                next_border = int(border[:m].min())
            u, place[:m] = bits.rice(place[:m], k[:m])
            residual[i, :m] = (u >> 1) ^ -(u & 1)
        at[w] = place
        spread = np.zeros((longest, frames), np.int64)
        for o in range(most + 1):
            some = order[w] == o
            spread[o:, w[some]] = residual[: longest - o, some]
        moving = np.flatnonzero(~verbatim)
        y, c, s, o = x[:, moving], coefficients[:, moving], shift[moving], order[moving]
        r = spread[:, moving]
    else:
        moving = np.flatnonzero(constant)
        y, c, s, o, r = x[:, moving], coefficients[:, moving], shift[moving], order[moving], np.zeros((longest, len(moving)), np.int64)
    for i in range(longest):
        pred = np.zeros(len(moving), np.int64)
        for j in range(min(i, most)):
            pred += c[j] * y[i - 1 - j]
        new = r[i] + (pred >> s)
        y[i] = new if i >= most else np.where(i >= o, new, y[i])
    x[:, moving] = y
    ends = (at + 7) // 8
    if (crc16(buffer, starts, ends - starts) != (buffer[ends].astype(np.uint32) << 8 | buffer[ends + 1])).any():
        raise ValueError("wrong checksum of a frame")
    return x, n, number, ends + 2


def _metadata(stream: bytes) -> tuple[int, bytes, list[int], int]:
    """(samples, MD5, frame offsets from the seek table, where frames begin)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, samples, digest = 4, False, [], 0, b""
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 36 & 31, packed >> 41 & 7) != (7, 0):
                raise ValueError("only 8-bit mono is read")
            samples, digest = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = np.frombuffer(body, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])["byte"].astype(np.int64).tolist()
        at += 4 + size
    return samples, digest, points, at


def decode(streams: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """(samples plus 128 as bytes, first sample of each block) of each stream."""
    found = [_metadata(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    buffer = np.frombuffer(b"".join(streams), np.uint8)
    starts, of = [], []
    for k, (samples, _, points, at) in enumerate(found):
        if not points and samples:
            points, here = [], 0
            while here < len(streams[k]) - at:
                points.append(here)
                here = int(decode_frames(np.frombuffer(streams[k], np.uint8, offset=at), np.array([here]))[3][0])
        starts += [int(base[k]) + at + p for p in points]
        of += [k] * len(points)
    starts, of = np.array(starts, np.int64), np.array(of, np.int64)
    pieces: list[list[np.ndarray]] = [[] for _ in streams]
    for a in range(0, len(starts), TOGETHER):
        some = starts[a : a + TOGETHER]
        low = int(some[0])
        high = int(base[of[min(a + TOGETHER, len(of)) - 1] + 1])
        x, n, number, _ = decode_frames(buffer[low:high], some - low)
        x = np.where(np.arange(len(x))[:, None] < n, x, 0)
        if x.min() < -128 or x.max() > 127:
            raise ValueError("a sample beyond 8 bits")
        rows = np.ascontiguousarray((x + 128).astype(np.uint8).T)
        for f, k in enumerate(of[a : a + TOGETHER].tolist()):
            if number[f] != len(pieces[k]):
                raise ValueError("frames out of order")
            pieces[k].append(rows[f, : n[f]])
    out = []
    for k, (samples, digest, *_) in enumerate(found):
        pcm = np.concatenate([*pieces[k], np.zeros(0, np.uint8)])
        if len(pcm) != samples or hashlib.md5((pcm ^ 0x80).tobytes()).digest() != digest:
            raise ValueError("the stream's samples or their MD5 differ")
        out.append((pcm.tobytes(), np.cumsum([0, *(len(p) for p in pieces[k][:-1])]).tolist() if pieces[k] else []))
    return out
