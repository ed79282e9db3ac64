import hashlib
import struct
import zlib

import numpy as np
import pytest

from isoreach.llm import flac

rng = np.random.default_rng(0)
CASES = [b"", b"\0" * 64, b"a" * 5000, bytes(rng.integers(0, 256, 9000, np.uint8)), "Éai les, oution. ".encode() * 700, b"x", b"ab", b"abc", bytes(range(256)) * 40, b"\xff\x00" * 3000, b"z" * 4096, b"q" * 4097]


def test_round_trip():
    streams = flac.encode(CASES)
    assert flac.decode(streams) == CASES
    for s, p in zip(streams, CASES, strict=True):
        assert flac.decode([s]) == [p]
        info = flac.Info(s)
        assert (flac._plain(s, info).astype(np.int8).view(np.uint8) ^ 128).tobytes() == p
        if len(p) > flac.BLOCK:
            first, pcm = flac.read_block(s, flac.BLOCK)
            assert first == flac.BLOCK and pcm == p[first : first + flac.BLOCK]
    assert len(streams[4]) < len(CASES[4])


def test_damage():
    s = flac.encode([CASES[4]])[0]
    info = flac.Info(s)
    for i in (0, info.frames + 2, info.frames + 60, len(s) - 1, 20):
        bad = bytearray(s)
        bad[i] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])
    with pytest.raises(flac.FlacError):
        flac.decode([s[:-1]])


def put(bits, value, n):
    bits += [value >> (n - 1 - i) & 1 for i in range(n)]


def lpc_stream(x, coef, shift, method=0, parts=0, escape=False):
    """A stream of one LPC frame, written bit by bit."""
    o, bits = len(coef), []
    put(bits, 0, 1), put(bits, 31 + o, 6), put(bits, 0, 1)
    for v in x[:o]:
        put(bits, int(v) & 255, 8)
    put(bits, 11, 4), put(bits, shift, 5)
    for c in coef:
        put(bits, c & 4095, 12)
    put(bits, method, 2), put(bits, parts, 4)
    res = [int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(coef)) >> shift) for i in range(o, len(x))]
    size = len(x) >> parts
    for p in range(1 << parts):
        part = res[max(0, p * size - o) : (p + 1) * size - o]
        w = 4 + method
        if escape:
            put(bits, (1 << w) - 1, w), put(bits, 12, 5)
            for e in part:
                put(bits, e & 4095, 12)
        else:
            put(bits, 3, w)
            for e in part:
                u = 2 * e if e >= 0 else -2 * e - 1
                bits += [0] * (u >> 3) + [1]
                put(bits, u & 7, 3)
    body = np.packbits(np.array(bits, np.uint8)).tobytes()
    frame = flac._header(0, len(x)) + body
    c = int(flac.crc16(np.frombuffer(frame + b"\0", np.uint8), np.array([0]), np.array([len(frame)]))[0])
    payload = (x.astype(np.int8).view(np.uint8) ^ 128).tobytes()
    return flac._stream(payload, [0], [len(x)], frame + struct.pack(">H", c)), payload


@pytest.mark.parametrize("kw", [{}, {"parts": 3}, {"method": 1}, {"escape": True, "parts": 1}])
def test_lpc(kw):
    x = np.clip(60 * np.sin(np.arange(512) / 9) + rng.normal(0, 2, 512), -128, 127).astype(np.int64)
    s, payload = lpc_stream(x, [1900, -980], 10, **kw)
    assert flac.decode([s, *flac.encode(CASES[:5])]) == [payload, *CASES[:5]]


def test_crc_and_numbers():
    assert flac.crc8(b"123456789") == 0xF4
    assert int(flac.crc16(np.frombuffer(b"123456789\0", np.uint8), np.array([0]), np.array([9]))[0]) == 0xFEE8
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20):
        assert flac._utf8(n) == (chr(n).encode() if not 0xD800 <= n < 0xE000 else flac._utf8(n))


def test_column(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Ünder 😀 " * 2000, "c"), (3, "Ünder 😀 " * 2000, "c"), (None, "x" * 64, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted(flac.round_trip(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r, (i, t, _) in zip(got, rows, strict=True):
        p = flac.pad((t or "").encode())
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len((t or "").encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
    assert got[2] == got[3] and got[0]["media_sha256"] == got[1]["media_sha256"]
    assert flac.round_trip(docs.limit(0)).count() == 0
    blocks = {(r[0], r[1]): r[2] for r in flac.pcm_blocks(flac.media_column(docs.filter("doc_id = 3").limit(1))).collect()}
    assert b"".join(blocks[k] for k in sorted(blocks)) == flac.pad(rows[2][1].encode())
