"""FLAC: streams built by hand for every branch of the reader, slices, seeking, PCM blocks, odd tables."""

import hashlib
import random
import struct

import numpy as np
import pytest

from lodestream.llm import flac


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        return np.packbits(self.bits + [0] * (-len(self.bits) % 8)).tobytes()


def crc(data, poly, bits):
    value = 0
    for byte in data:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ poly if value >> (bits - 1) else value << 1) & ((1 << bits) - 1)
    return value


def stream(samples, sub, block):
    """A stream of one block size; `sub` writes the subframe of each block's samples."""
    frames = []
    for i, a in enumerate(range(0, len(samples), block)):
        own = samples[a : a + block]
        head = b"\xff\xf8\x70\x02" + flac._number(i) + struct.pack(">H", len(own) - 1)
        b = Bits()
        sub(b, own)
        body = head + bytes([crc(head, 0x07, 8)]) + b.bytes()
        frames.append(body + struct.pack(">H", crc(body, 0x8005, 16)))
    raw = np.array(samples, np.int8).tobytes()
    info = struct.pack(">HH", block, block) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames), (np.frombuffer(raw, np.uint8) ^ 128).tobytes()


def residual(samples, order, lpc=None, shift=0):
    fixed = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
    c = fixed[order] if lpc is None else lpc
    return [samples[i] - (sum(w * samples[i - 1 - j] for j, w in enumerate(c)) >> shift) for i in range(order, len(samples))]


def writer(order, lpc=None, shift=0, parts=0, wide=False, escape=False, wasted=0):
    def sub(b, samples):
        s = [x >> wasted for x in samples]
        b.put(0, 1)
        b.put(31 + order if lpc is not None else 8 + order, 6)
        b.put(1 if wasted else 0, 1)
        if wasted:
            b.put(1, wasted)
        for x in s[:order]:
            b.put(x & ((1 << (8 - wasted)) - 1), 8 - wasted)
        if lpc is not None:
            b.put(9, 4)
            b.put(shift & 31, 5)
            for c in lpc:
                b.put(c & 1023, 10)
        b.put(int(wide), 2)
        b.put(parts, 4)
        res, at = residual(s, order, lpc, shift), 0
        for p in range(1 << parts):
            n = len(s) // (1 << parts) - (order if p == 0 else 0)
            own, at = res[at : at + n], at + n
            if escape and p % 2 == 0:
                b.put(31 if wide else 15, 5 if wide else 4)
                b.put(12, 5)
                for r in own:
                    b.put(r & 4095, 12)
            else:
                b.put(3, 5 if wide else 4)
                for r in own:
                    b.rice(r, 3)

    return sub


SAMPLES = [max(-128, min(126, int(60 * np.sin(i / 7) + random.Random(i).randint(-9, 9)) // 2 * 2)) for i in range(64 * 9)]


@pytest.mark.parametrize(
    "shape",
    [dict(order=o) for o in range(5)] + [dict(order=2, parts=3), dict(order=1, wide=True), dict(order=3, parts=2, wide=True, escape=True), dict(order=0, escape=True), dict(order=2, wasted=1)]
    + [dict(order=1, lpc=[500], shift=9), dict(order=3, lpc=[511, -200, 90], shift=8), dict(order=2, lpc=[300, -100], shift=8, parts=2, escape=True), dict(order=8, lpc=[90, -80, 70, -60, 50, -40, 30, -20], shift=7), dict(order=2, lpc=[200, -90], shift=7, wasted=1)],
)
def test_reader_of_handmade_streams(shape):
    made, payload = stream(SAMPLES, writer(**shape), 64)
    assert flac.decode_streams([made, made]) == [payload, payload]
    assert flac.read_samples(made, 70, 200) == payload[70:270]


def test_verbatim_and_constant():
    def verbatim(b, s):
        b.put(1 << 1, 8)
        for x in s:
            b.put(x & 255, 8)

    def constant(b, s):
        b.put(0, 8)
        b.put(s[0] & 255, 8)

    for sub, samples in ((verbatim, SAMPLES), (constant, [-7] * 130)):
        made, payload = stream(samples, sub, 64)
        assert flac.decode_streams([made]) == [payload]


def test_the_writer_uses_every_predictor_and_survives_damage():
    rnd = np.random.default_rng(1)
    wave = (128 + 60 * np.sin(np.arange(3000) / 3) + rnd.integers(0, 3, 3000)).astype(np.uint8).tobytes()
    ramp = bytes((i // 2) % 256 for i in range(1920))
    payloads = [wave, ramp, b"a" * 1152, rnd.integers(0, 256, 1344, dtype=np.uint8).tobytes(), b"the cat sat on the mat " * 192]
    streams = flac.encode_streams(payloads)
    kinds = set()
    for s in streams:
        for _, at, _ in flac.seek_points(s):
            kinds.add(s[flac._header(s, at)[2]] >> 1)
    assert {0, 1} <= kinds and any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)
    assert flac.decode_streams(streams) == payloads
    for at in (len(streams[0]) - 1, len(streams[0]) // 2, len(streams[0]) - 700, flac.seek_points(streams[0])[0][1] + 4):
        bad = bytearray(streams[0])
        bad[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(bad)])


def test_a_long_payload_goes_in_slices(monkeypatch):
    monkeypatch.setattr(flac, "TOGETHER", 5 * flac.BLOCK)
    rnd = random.Random(2)
    payload = " ".join(rnd.choice(["alpha", "beta", "gamma", "\x00\xff"]) for _ in range(40_000)).encode("latin-1")
    made = flac.encode_streams([payload, b"x" * 192, payload[:7000]])
    monkeypatch.undo()
    assert made == flac.encode_streams([payload, b"x" * 192, payload[:7000]])
    monkeypatch.setattr(flac, "TOGETHER", 5 * flac.BLOCK)
    assert flac.decode_streams(made) == [payload, b"x" * 192, payload[:7000]]
    for a, n in ((0, 10), (1151, 2), (100_000, 5000), (len(payload) - 3, 99), (len(payload) + 5, 4)):
        assert flac.read_samples(made[0], a, n) == payload[a : a + n]


def test_media_columns_of_odd_tables(spark):
    long = "ü long text " * 600_000
    rows = [(1, None, b"m", 1), (1, "", b"m", 1), (None, "abc", b"m", 1), (2, long, b"m", 1), (2, "abc", b"m", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary, n_bytes long")
    media = flac.encode_media(df)
    want = sorted((r[0] or 0, ((r[1] or "").encode() + b" " * (-len((r[1] or "").encode()) % 192 or (0 if r[1] else 192)))) for r in rows)
    assert sorted((r.doc_id or 0, bytes(r.pcm)) for r in flac.decode_media(media).collect()) == want
    blocks = flac.pcm_blocks(media.where("doc_id = 2 AND n_bytes > 3"), 1 << 20).orderBy("sample_offset").collect()
    assert b"".join(bytes(r.pcm) for r in blocks) == want[-1][1] and [r.sample_offset for r in blocks] == list(range(0, len(want[-1][1]), 1 << 20))
    assert flac.store_and_read(df.where("false")).count() == 0
