"""Media columns as FLAC: bytes stored losslessly as 8-bit samples, read back frame by frame.

The writer makes mono 8-bit streams of fixed block size with a seek point for every frame; each frame
takes the cheapest of the constant, fixed linear (orders 0 to 2), adaptive linear (LPC, order 4) and
verbatim predictors and one Rice parameter. The reader handles constant, verbatim, fixed (0 to 4) and
LPC subframes, wasted bits and partitioned, escaped and plain Rice residuals with either parameter
width, checks every frame's CRC-8 and CRC-16 and the stream's MD5, and raises ValueError where they
differ. Frames are worked on together in slices of bounded size, whatever a payload's length: one
step of NumPy moves all frames of a slice by one symbol. A stream's samples can be read from any
place by its seek points, and as blocks of PCM with their sample offsets.

Defined results: a null or empty text is a payload of spaces; equal payloads give equal streams, of
equally cheap predictors the first named; repeated rows are kept; a very long text needs memory for
its payload, its stream and one slice; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, PAD, RATE = 1152, 192, 8000
#: Frames of a seek point.
SEEK = 1
#: Bytes worked on together, a whole number of blocks; NumPy needs about 150 times as much.
TOGETHER = 1200 * BLOCK
#: Order of the adaptive predictor and bits of its coefficients.
ORDER, PRECISION = 4, 12


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint16)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRCs of many slices of data; zeros in front change nothing, so slices are aligned at their ends."""
    out = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return out
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    value = np.zeros(len(order), np.uint16)
    end = at + left
    # How many slices are still as long as each step asks, longest first.
    counts = np.searchsorted(-left, -np.arange(int(left[0]), 0, -1), "right").tolist()
    for n, step in zip(counts, range(int(left[0]), 0, -1), strict=True):
        byte = data[end[:n] - step]
        v = value[:n]
        value[:n] = table[v ^ byte] if bits == 8 else (v << 8) ^ table[(v >> 8) ^ byte]
    out[order] = value
    return out


def _number(n: int) -> bytes:
    """A frame number in the stretched UTF-8 of the format."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 63)
        n >>= 6
    return bytes([(0xFF << (7 - len(tail)) | n) & 0xFF, *reversed(tail)])


def _number_at(b: bytes, at: int) -> tuple[int, int]:
    """A frame number and the place after it."""
    x = b[at]
    if x < 0x80:
        return x, at + 1
    more = 8 - (x ^ 0xFF).bit_length() - 1
    n = x & (0x3F >> more)
    for i in range(1, more + 1):
        n = n << 6 | b[at + i] & 63
    return n, at + 1 + more


def _adapted(x: np.ndarray, start: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole coefficients (ORDER x frames) and shifts of each frame's linear predictor, by Levinson and Durbin."""
    y = x.astype(np.float64)
    r = [np.add.reduceat(y * y, start)]
    for lag in range(1, ORDER + 1):
        product = np.zeros(len(y))
        product[lag:] = y[lag:] * y[:-lag]
        product[place < lag] = 0
        r.append(np.add.reduceat(product, start))
    a, left = np.zeros((ORDER, len(n))), r[0] * (1 + 1e-9) + 1e-9
    for i in range(ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / left
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        left = np.maximum(left * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)), -limit - 1, limit).astype(np.int64), shift


def _encode_frames(parts: list[tuple[bytes, int]], block: int) -> list[list[bytes]]:
    """The frames of each part (its bytes, a whole number of blocks but for a stream's last, and the number of its first frame)."""
    size = np.fromiter((len(b) for b, _ in parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(b for b, _ in parts), np.uint8)
    x = (raw.astype(np.int16) - 128).astype(np.int32)
    frames = -(-size // block)
    part = np.repeat(np.arange(len(size)), frames)
    nth = np.arange(len(part)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = (np.cumsum(size) - size)[part] + nth * block
    n = np.minimum(block, size[part] - nth * block)
    number = nth + np.fromiter((f for _, f in parts), np.int64, len(parts))[part]
    place = np.arange(len(x)) - np.repeat(start, n)
    d1 = np.diff(x, prepend=x[:1])
    d2 = np.diff(d1, prepend=d1[:1])
    coefficients, shift = _adapted(x, start, n, place)
    ahead, frame = np.zeros(len(x), np.int32), np.repeat(np.arange(len(n), dtype=np.int32), n)
    for j, c in enumerate(coefficients.astype(np.int32)):
        ahead[j + 1 :] += c[frame[j + 1 :]] * x[: -j - 1]
    adapted = x - (ahead >> shift.astype(np.int32)[frame])
    # Cost of each predictor with the best Rice parameter near the one that its mean suggests, in bits.
    best = np.full(len(n), 1 << 60, np.int64)
    order, rice, lpc = np.full(len(n), -1), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    folded = []
    for k, d, head in ((0, x, 0), (1, d1, 0), (2, d2, 0), (ORDER, adapted, 9 + PRECISION * ORDER)):
        u = np.where(d < 0, -2 * d - 1, 2 * d).astype(np.int32)
        u[place < k] = 0
        folded.append(u)
        count = np.maximum(n - k, 0)
        mean = np.add.reduceat(u, start) / np.maximum(count, 1)  # a block of 9-bit values fits 32 bits
        near = np.floor(np.log2(np.maximum(0.7 * mean, 1))).astype(np.int64)
        for r in (0, 1):
            own = near + r
            cost = np.add.reduceat(u >> own.astype(np.int32)[frame], start) + count * (1 + own) + 8 * k + head
            better = (cost < best) & (n > k)
            best[better], order[better], rice[better], lpc[better] = cost[better], k, own[better], head > 0
    verbatim = best >= 8 * n
    constant = np.maximum.reduceat(x, start) == np.minimum.reduceat(x, start)
    order[verbatim], order[constant] = -1, -2
    lpc &= order > 0
    # Every symbol's code: warm-up and verbatim samples are 8 plain bits.
    per, pick = order.astype(np.int32)[frame], np.where(lpc, 3, np.maximum(order, 0))[frame]
    u = np.choose(pick, folded)
    plain = (per < 0) | (place < per)
    u[plain] = raw[plain] ^ 128
    k = np.where(plain, np.int32(8), rice.astype(np.int32)[frame])
    q = np.where(plain, 0, u >> k)
    length = np.where(plain, 8, q + 1 + k)
    length[(per == -2) & (place > 0)] = 0
    # Before the residuals: the adaptive predictor, then coding method, partition order and Rice parameter.
    own = np.where(lpc, 9 + PRECISION * ORDER, 0)
    lead = np.where(order >= 0, 10, 0) + own
    first = np.add.reduceat(length, start)
    warm = np.maximum(order, 0) * 8
    bits = -(-(first + lead) // 8) * 8
    base = np.cumsum(bits) - bits
    ends = np.cumsum(length)
    begin = (base - (ends - length)[start])[frame] + (ends - length) + np.where(plain, 0, lead[frame])
    out = np.zeros(int(bits.sum()) + 8, np.uint8)
    coded = ~plain
    out[(begin + q)[coded]] = 1
    low = begin + np.where(plain, 0, q + 1)
    # From the last bit of each symbol to the first; symbols run out as their width does.
    left = np.flatnonzero(length > 0)
    low, width, u = low[left], k[left], u[left]
    for j in range(int(width.max())):
        more = width > j
        if not more.all():
            low, width, u = low[more], width[more], u[more]
        out[low + (width - 1 - j)] = (u >> j) & 1
    has = np.flatnonzero(order >= 0)
    for j in range(4):
        out[base[has] + warm[has] + own[has] + 6 + j] = rice[has] >> (3 - j) & 1
    has = np.flatnonzero(lpc)
    fields = [(4, np.full(len(has), PRECISION - 1)), (5, shift[has]), *((PRECISION, c[has]) for c in coefficients)]
    at = base[has] + warm[has]
    for width, value in fields:
        for j in range(width):
            out[at + j] = value >> (width - 1 - j) & 1
        at = at + width
    body = np.packbits(out)
    heads = []
    for i in range(len(n)):
        kind = 0 if order[i] == -2 else 1 if order[i] == -1 else 31 + int(order[i]) if lpc[i] else 8 | int(order[i])
        heads.append((b"\xff\xf8\x70\x02" + _number(int(number[i])) + struct.pack(">H", int(n[i]) - 1), bytes([kind << 1])))
    head = np.fromiter((len(a) for a, _ in heads), np.int64, len(heads))
    joined = np.frombuffer(b"".join(a for a, _ in heads), np.uint8)
    crc8 = _crc(joined, np.cumsum(head) - head, head, _CRC8, 8)
    data, at = body.tobytes(), base // 8
    pieces = [b"".join((a, bytes((int(c),)), b, data[s : s + m // 8])) for (a, b), c, s, m in zip(heads, crc8, at.tolist(), bits.tolist(), strict=True)]
    total = np.fromiter(map(len, pieces), np.int64, len(pieces))
    crc16 = _crc(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(total) - total, total, _CRC16, 16)
    pieces = [p + struct.pack(">H", int(c)) for p, c in zip(pieces, crc16, strict=True)]
    cut = np.cumsum(frames)
    return [pieces[b - f : b] for b, f in zip(cut.tolist(), frames.tolist(), strict=True)]


def _together(sizes) -> list[list[int]]:
    """Runs of neighbours of about TOGETHER in all."""
    runs, left = [], 0
    for i, size in enumerate(sizes):
        if size > left:
            runs.append([])
            left = TOGETHER
        runs[-1].append(i)
        left -= size
    return runs


def encode_streams(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream of each payload; none is empty."""
    step = max(1, TOGETHER // block) * block
    parts = [(i, a) for i, p in enumerate(payloads) for a in range(0, len(p), step)]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for run in _together(min(step, len(payloads[i]) - a) for i, a in parts):
        own = [parts[j] for j in run]
        for (i, _), made in zip(own, _encode_frames([(payloads[i][a : a + step], a // block) for i, a in own], block), strict=True):
            frames[i] += made
    result = []
    for payload, own in zip(payloads, frames, strict=True):
        sizes = list(map(len, own))
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        offset, points = 0, []
        # A seek table holds 24 bits of length: for a very long stream one point stands for several frames.
        every = SEEK * max(1, -(-len(sizes) // 900_000))
        for j, s in enumerate(sizes):
            if j % every == 0:
                points.append(struct.pack(">QQH", j * block, offset, min(block, len(payload) - j * block)))
            offset += s
        points = b"".join(points)
        result.append(b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(points).to_bytes(3, "big"), points, *own]))
    return result


def _uint(data: np.ndarray, at: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Unsigned fields of up to 24 bits at bit offsets; data has four bytes more than it needs."""
    byte = at >> 3
    word = (data[byte].astype(np.int64) << 24) | (data[byte + 1].astype(np.int64) << 16) | (data[byte + 2].astype(np.int64) << 8) | data[byte + 3]
    return (word >> (32 - bits - (at & 7))) & ((1 << np.asarray(bits, np.int64)) - 1)


def _signed(v: np.ndarray, bits) -> np.ndarray:
    half = 1 << (np.asarray(bits, np.int64) - 1)
    return (v ^ half) - half


_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def _header(b: bytes, at: int) -> tuple[int, int, int]:
    """Sample count, frame number and the place after the header's CRC."""
    if b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] >> 4:
        raise ValueError("no mono frame where one must begin")
    code, rate = b[at + 2] >> 4, b[at + 2] & 15
    number, p = _number_at(b, at + 4)
    n = _SIZES.get(code, 0)
    if code in (6, 7):
        n = int.from_bytes(b[p : p + code - 5], "big") + 1
        p += code - 5
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not n:
        raise ValueError("reserved block size")
    return n, number, p + 1


def _opened(s: bytes) -> tuple[list[tuple[int, int, int, int, int]], bytes, int]:
    """Tracks from seek point to seek point (place of the first frame, samples, number of that frame, end, first sample), the samples' MD5 and their number."""
    if s[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, seek, ended = 4, b"", [], False
    while not ended:
        ended, kind, n = bool(s[at] >> 7), s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        if kind == 0:
            info = s[at + 4 : at + 4 + n]
        elif kind == 3:
            seek = [p for j in range(0, n, 18) if (p := struct.unpack_from(">QQH", s, at + 4 + j))[0] < 1 << 63]
        at += 4 + n
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 36 & 31) + 1 != 8 or packed >> 41 & 7:
        raise ValueError("the stream must hold one channel of 8 bits")
    total, block = packed & (1 << 36) - 1, int.from_bytes(info[:2], "big")
    if not seek or seek[0][:2] != (0, 0) or any(p[0] % block for p in seek):
        seek = [(0, 0, 0)]
    ends = [*((p[0], p[1]) for p in seek[1:]), (total, len(s) - at)]
    return [(at + offset, stop - sample, sample // block, at + to, sample) for (sample, offset, _), (stop, to) in zip(seek, ends, strict=True)], info[18:34], total


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, every frame's checksums and each stream's MD5 verified."""
    opened = [_opened(s) for s in streams]
    tracks = [(i, t) for i, (own, _, _) in enumerate(opened) for t in own if t[1] > 0]
    pcm: list[list[bytes]] = [[] for _ in streams]
    for run in _together(t[1] for _, t in tracks):
        own = [tracks[j] for j in run]
        for (i, _), samples in zip(own, _decode_tracks([(streams[i], t) for i, t in own]), strict=True):
            pcm[i].append(samples)
    out = []
    for (_, md5, _), own in zip(opened, pcm, strict=True):
        whole = b"".join(own)
        if hashlib.md5(whole).digest() != md5:
            raise ValueError("the samples' MD5 differs")
        out.append((np.frombuffer(whole, np.uint8) ^ 128).tobytes())
    return out


def read_samples(stream: bytes, start: int, length: int) -> bytes:
    """So many samples of a payload from `start` on; only the frames that hold them are decoded and verified."""
    tracks, _, total = _opened(stream)
    stop = min(start + length, total)
    own = [t for t in tracks if t[4] < stop and t[4] + t[1] > start]
    parts = [x for run in _together(t[1] for t in own) for x in _decode_tracks([(stream, own[j]) for j in run])]
    whole = b"".join(parts)[start - own[0][4] : stop - own[0][4]] if own else b""
    return (np.frombuffer(whole, np.uint8) ^ 128).tobytes()


def _decode_tracks(tracks: list[tuple[bytes, tuple[int, int, int, int, int]]]) -> list[bytes]:
    """The samples (signed bytes) of each track; all tracks go frame by frame together.

    Frames of one plain Rice partition are decoded in step; frames of any other shape go through
    decode_frame, one at a time.
    """
    raw = b"".join(s[t[0] : t[3]] for s, t in tracks) + bytes(8)
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([t[3] - t[0] for _, t in tracks]).tolist()
    # Place of the next frame, samples left, number of that frame.
    now = [[e - (t[3] - t[0]), t[1], t[2]] for e, (_, t) in zip(ends, tracks, strict=True)]
    # For every bit the next one that is set.
    bits = np.unpackbits(data)
    following = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    following = np.minimum.accumulate(following[::-1])[::-1]
    done: list[list[np.ndarray]] = [[] for _ in tracks]
    live = list(range(len(tracks)))
    while live:
        heads = [_header(raw, now[t][0]) for t in live]
        if any(h[1] != now[t][2] for h, t in zip(heads, live, strict=True)):
            raise ValueError("a frame is out of order")
        n = np.array([h[0] for h in heads])
        begin = np.array([now[t][0] for t in live])
        body = np.array([h[2] for h in heads])
        if (_crc(data, begin, body - 1 - begin, _CRC8, 8) != data[body - 1]).any():
            raise ValueError("a frame header's CRC-8 differs")
        kind = data[body].astype(np.int64)
        bit, code = (body + 1) * 8, kind >> 1
        lpc = code >= 32
        order = np.where(lpc, code - 31, code - 8)
        plain = (kind & 1 == 0) & (lpc | (code >= 8) & (code <= 12))
        own = np.flatnonzero(plain)
        after = bit[own] + 8 * order[own]
        precision = np.where(lpc[own], _uint(data, np.minimum(after, len(bits) - 64), 4) + 1, 0)
        rice = after + np.where(lpc[own], 9 + precision * order[own], 0)
        same = (rice < len(bits) - 64) & (_uint(data, np.minimum(rice, len(bits) - 64), 6) == 0) & (_uint(data, np.minimum(rice, len(bits) - 64) + 6, 4) != 15)
        own, precision, rice = own[same], precision[same], rice[same]
        end = np.zeros(len(live), np.int64)
        samples: list[np.ndarray | None] = [None] * len(live)
        if len(own):
            values, stops = _lockstep(data, following, bit[own], order[own], n[own], precision, rice)
            end[own] = -(-stops // 8)
            for j, v in zip(own, values, strict=True):
                samples[j] = v
        for j in range(len(live)):
            if samples[j] is None:
                samples[j], end[j] = decode_frame(data, int(bit[j]), int(kind[j]), int(n[j]))
        if (end + 2 > len(raw)).any() or (_crc(data, begin, end - begin, _CRC16, 16) != (data[end].astype(np.uint16) << 8 | data[end + 1])).any():
            raise ValueError("a frame's CRC-16 differs")
        for j, t in enumerate(live):
            done[t].append(samples[j])
            now[t] = [int(end[j]) + 2, now[t][1] - int(n[j]), now[t][2] + 1]
            if now[t][1] <= 0 and (now[t][1] < 0 or now[t][0] != ends[t]):
                raise ValueError("a seek point is not where the frames before it end")
        live = [t for t in live if now[t][1] > 0]
    return [np.concatenate(own).astype(np.int8).tobytes() for own in done]


def _lockstep(data, following, bit, order, n, precision, rice):
    """Fixed and adaptive subframes (precision > 0) with one Rice partition at `rice`: their samples and where they end, in bits."""
    frames, most = len(n), int(n.max())
    k = _uint(data, rice + 6, 4)
    # Rows above the samples are zeros, so that a prediction may look beyond the first.
    high = int(order.max())
    res = np.zeros((high + most, frames), np.int64)
    for j in range(high):
        own = np.flatnonzero(order > j)
        res[high + j, own] = _signed(_uint(data, bit[own] + 8 * j, 8), 8)
    sort = np.argsort(-n, kind="stable")
    at, k_, o_, n_ = rice[sort] + 10, k[sort], order[sort], n[sort]
    begins = range(int(o_.min()), most)
    for m, step in zip(np.searchsorted(-n_, -np.array(begins, np.int64), "left").tolist(), begins, strict=True):
        go = slice(0, m) if step >= high else np.flatnonzero(o_[:m] <= step)
        stop = following[at[go]]
        u = (stop - at[go]) << k_[go] | _uint(data, stop + 1, k_[go])
        res[high + step, sort[go]] = (u >> 1) ^ -(u & 1)
        at[go] = stop + 1 + k_[go]
    stops = np.empty_like(at)
    stops[sort] = at
    own = np.flatnonzero(precision > 0)
    if len(own):
        width, o, s = precision[own], order[own], res[:, own]
        shift = _signed(_uint(data, bit[own] + 8 * o + 4, 5), 5)
        weights = np.zeros((high, len(own)), np.int64)
        for j in range(high):
            has = np.flatnonzero(o > j)
            weights[high - 1 - j, has] = _signed(_uint(data, bit[own[has]] + 8 * o[has] + 9 + width[has] * j, width[has]), width[has])
        first = int(o.min())
        for step in range(first, most):
            ahead = np.einsum("jf,jf->f", weights, s[step : step + high]) >> shift
            s[high + step] += np.where(o <= step, ahead, 0) if step < high else ahead
        res[:, own] = s
    values = []
    for f in range(frames):
        v = res[high : high + n[f], f]
        values.append(v if precision[f] else _integrate(v, int(order[f])))
    return values, stops


def _integrate(res: np.ndarray, order: int) -> np.ndarray:
    """Samples from warm-up samples and residuals of a fixed predictor."""
    if order == 0:
        return res
    warm = res[:order]
    seeds = [np.diff(warm, n)[-1] if n else warm[-1] for n in range(order)]
    tail = res[order:]
    for n in range(order - 1, -1, -1):
        tail = seeds[n] + np.cumsum(tail)
    return np.concatenate([warm, tail])


def decode_frame(data: np.ndarray, bit: int, kind: int, n: int) -> tuple[np.ndarray, int]:
    """Samples of any mono 8-bit subframe and the byte after its last one; `bit` follows the subframe's type."""
    get = lambda width: int(_uint(data, np.array([bit]), width)[0])
    wasted = 0
    if kind & 1:
        while True:
            wasted, done, bit = wasted + 1, get(1), bit + 1
            if done:
                break
    bps, code = 8 - wasted, kind >> 1
    out = np.zeros(n, np.int64)
    if code == 0:
        out[:] = _signed(np.array(get(bps)), bps)
        bit += bps
    elif code == 1:
        out[:] = _signed(_uint(data, bit + bps * np.arange(n), bps), bps)
        bit += bps * n
    else:
        if 8 <= code <= 12:
            order, lpc = code - 8, None
        elif code >= 32:
            order, lpc = code - 31, []
        else:
            raise ValueError("reserved subframe type")
        out[:order] = _signed(_uint(data, bit + bps * np.arange(order), bps), bps) if order else 0
        bit += bps * order
        shift = 0
        if lpc is not None:
            precision = get(4) + 1
            bit += 4
            shift = int(_signed(np.array(get(5)), 5))
            bit += 5
            lpc = _signed(_uint(data, bit + precision * np.arange(order), precision), precision).tolist()
            bit += precision * order
        wide, parts = 4 + get(2), 1 << (get(6) & 15)
        bit += 6
        at = order
        for p in range(parts):
            k, stop = get(wide), n // parts * (p + 1)
            bit += wide
            if k == (1 << wide) - 1:
                width = get(5)
                bit += 5
                if width:
                    out[at:stop] = _signed(_uint(data, bit + width * np.arange(stop - at), width), width)
                bit += width * (stop - at)
                at = stop
                continue
            while at < stop:
                q = 0
                while not (data[bit >> 3] >> (7 - (bit & 7))) & 1:
                    q, bit = q + 1, bit + 1
                bit += 1
                u = q << k | (get(k) if k else 0)
                bit += k
                out[at] = (u >> 1) ^ -(u & 1)
                at += 1
        if lpc is None:
            out = _integrate(out, order)
        else:
            s = out.tolist()
            for i in range(order, n):
                s[i] += sum(c * s[i - 1 - j] for j, c in enumerate(lpc)) >> shift
            out = np.array(s)
    return out << wasted, -(-bit // 8)


def seek_points(stream: bytes) -> list[tuple[int, int, int]]:
    """Sample number, byte offset and samples of each seek point's track."""
    return [(sample, at, n) for at, n, _, _, sample in _opened(stream)[0]]


def _in_batches(batches, column: int, work):
    """work(values) for runs of about TOGETHER bytes of a binary column, with the batch's other columns."""
    for batch in batches:
        for a, b in common.chunks(batch.column(column), TOGETHER):
            part = batch.slice(a, b - a)
            yield part, work(part.column(column))


def _encoded(batches, pad: int, block: int):
    def work(texts):
        raw = [(t or "").encode() for t in texts.to_pylist()]
        return [len(r) for r in raw], encode_streams([r + b" " * (-len(r) % pad or (0 if r else pad)) for r in raw], block)

    for part, (sizes, streams) in _in_batches(batches, 1, work):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), common.binary_array(streams)], ["doc_id", "n_bytes", "media"])


def _decoded(batches):
    def feature(pcm: bytes, stream: bytes) -> str:
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        crossings = int((np.diff(np.sign(x)) != 0).sum())
        return f"samples={len(x)};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())};seek={len(seek_points(stream))}"

    def work(media):
        streams = media.to_pylist()
        pcm = decode_streams(streams)
        return pcm, list(map(feature, pcm, streams))

    for part, (pcm, features) in _in_batches(batches, 2, work):
        yield pa.RecordBatch.from_arrays([*part.columns, common.binary_array(pcm), pa.array(features, pa.string())], ["doc_id", "n_bytes", "media", "pcm", "feature"])


def pcm_blocks(df: DataFrame, samples: int = 1 << 16) -> DataFrame:
    """doc_id, sample_offset, n_samples, byte_offset (of the frame that holds the first sample) and pcm of each block of a media column, read by seek points."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for name, stream in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tracks, _, total = _opened(stream)
                first = np.array([t[4] for t in tracks])
                for a in range(0, total, samples):
                    pcm = read_samples(stream, a, samples)
                    at = tracks[int(np.searchsorted(first, a, "right")) - 1][0]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), *(pa.array([x], pa.int64()) for x in (a, len(pcm), at)), common.binary_array([pcm])], ["doc_id", "sample_offset", "n_samples", "byte_offset", "pcm"])

    return common.map_arrow(df.select("doc_id", "media"), run, f"doc_id {kind}, sample_offset long, n_samples long, byte_offset long, pcm binary")


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary"


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pad: int = PAD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes (before padding with spaces) and media (a FLAC stream)."""
    rows, kind = _rows(df, id_col, text_col)
    return common.map_arrow(rows, lambda batches: _encoded(batches, pad, block), kind)


def decode_media(df: DataFrame) -> DataFrame:
    """Adds pcm (the payload read back) and feature to doc_id, n_bytes and media."""
    kind = df.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(df.select("doc_id", "n_bytes", "media"), _decoded, f"doc_id {kind}, n_bytes long, media binary, pcm binary, feature string")


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pad: int = PAD, block: int = BLOCK) -> DataFrame:
    """decode_media(encode_media(df)) in one Python worker a task instead of two."""
    rows, kind = _rows(df, id_col, text_col)
    return common.map_arrow(rows, lambda batches: _decoded(_encoded(batches, pad, block)), f"{kind}, pcm binary, feature string")


def op8_media(spark, sf_dir: str) -> DataFrame:
    both = store_and_read(common.spread(common.table(spark, sf_dir, "documents")))
    size = F.octet_length("pcm")
    return both.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
