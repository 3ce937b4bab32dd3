"""MPEG streams of other encoders, damaged ones, and the round trip of the writer."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from maskmix.llm import media


def bitwise_crc(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        for k in range(7, -1, -1):
            c = (c << 1 ^ (0x8005 if (c >> 15 ^ b >> k) & 1 else 0)) & 0xFFFF
    return c


def frame(second: int, third: int, fourth: int, body: bytes = b"", side: int = 0) -> bytes:
    """A frame of any kind with the right length; protected if the second byte says so."""
    head = bytes((0xFF, second, third, fourth))
    h = media.header(head)
    if not second & 1:
        covered = body[:side].ljust(side, b"\0")
        body = struct.pack(">H", bitwise_crc(head[2:] + covered)) + covered + body[side:]
    return (head + body).ljust(h.length, b"\0")[: h.length]


@pytest.mark.parametrize("text", [None, "", "a", "é" * 3000, "x" * 63, "x" * 64])
def test_round_trip(text):
    payload, n = media.padded(text)
    s = media.parse(media.write(payload))
    assert s.payload == payload and len(payload) % 64 == 0 and payload and n == len((text or "").encode())
    assert s.vbr == "exact" and s.checked == s.frames and s.samples == 1152 * s.frames and s.texts == {"TSSE": "maskmix"} and s.tags == ["ID3v2", "ID3v1"]


# Second, third and fourth byte; length, samples, Hz: figures of the format for well-known settings.
@pytest.mark.parametrize(
    "given, want",
    [
        ((0xFB, 0x90, 0x00), (417, 1152, 44100)),  # layer III, 128 kbit/s, 44.1 kHz
        ((0xFB, 0x92, 0x00), (418, 1152, 44100)),  # padded
        ((0xF3, 0x80, 0xC0), (208, 576, 22050)),  # version 2, layer III, 64 kbit/s
        ((0xE3, 0x80, 0xC0), (417, 576, 11025)),  # version 2.5
        ((0xFD, 0xA4, 0x00), (576, 1152, 48000)),  # layer II, 192 kbit/s, 48 kHz
        ((0xFF, 0xC0, 0x00), (416, 384, 44100)),  # layer I, 384 kbit/s, 44.1 kHz
        ((0xF7, 0x14, 0x00), (64, 384, 24000)),  # version 2, layer I, 32 kbit/s
    ],
)
def test_headers(given, want):
    h = media.header(bytes((0xFF, *given)))
    assert (h.length, h.samples, h.hertz) == want
    s = media.parse(frame(*given) * 5)
    assert (s.frames, s.samples, s.hertz, s.resyncs) == (5, 5 * want[1], want[2], 0) and s.offsets == [want[0] * i for i in range(5)]


@pytest.mark.parametrize("four", [b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb"])
def test_no_headers(four):
    assert media.header(four) is None


@pytest.mark.parametrize("second, third, fourth, side", [(0xFA, 0x90, 0x00, 32), (0xFA, 0x90, 0xC0, 17), (0xF2, 0x80, 0xC0, 9), (0xFE, 0xC0, 0x00, 32), (0xFE, 0xC0, 0xC0, 16), (0xFE, 0xC0, 0x50, 20)])
def test_checksums(second, third, fourth, side):
    good = frame(second, third, fourth, bytes(range(1, 80)), side)
    bad = bytearray(good)
    bad[6 + side - 1] ^= 1
    after = bytearray(good)
    after[6 + side] ^= 1  # not covered
    s = media.parse(good + bytes(bad) + bytes(after))
    assert (s.frames, s.checked, s.damaged) == (3, 2, 1)


def xing(flags: int, *numbers: int, name: bytes = b"Xing") -> bytes:
    return frame(0xFB, 0x90, 0x00, bytes(32) + name + struct.pack(f">I{len(numbers)}I", flags, *numbers))


def test_tables():
    frames = frame(0xFB, 0x90, 0x00) * 3
    size = 4 * 417
    for front, want in (
        (xing(0), "unverified"),
        (xing(1, 3), "exact"),
        (xing(1, 4), "wrong"),
        (xing(2, size), "exact"),
        (xing(2, 3), "wrong"),
        (xing(3, 3, size, name=b"Info"), "exact"),
        (xing(3, 3, size - 1), "wrong"),
        (frame(0xFB, 0x90, 0x00, bytes(32) + b"VBRI" + struct.pack(">HHHII", 1, 0, 0, size, 3)), "exact"),
        (frame(0xFB, 0x90, 0x00, bytes(32) + b"VBRI" + struct.pack(">HHHII", 1, 0, 0, size, 9)), "wrong"),
        (b"", "none"),
    ):
        s = media.parse(front + frames)
        assert s.vbr == want and s.frames == 3
    # A frame that holds its table's flags and number of frames only: the size is not read.
    small = frame(0xF3, 0x10, 0xC0, bytes(9) + b"Xing\0\0\0\x0f\0\0\0\x01")
    assert len(small) == 26 and media.parse(small).vbr == "wrong" and media.parse(small * 2).vbr == "exact"
    assert media.table_of(small[:20], 0, 20, media.header(small[:4])) is None


def test_out_of_step():
    whole = media.write(media.padded("x" * 5000)[0])
    hurt = media.parse(b"\xff\xfa\x00junk" + whole[28:700] + b"??" + whole[700:])
    assert hurt.resyncs >= 1 and hurt.vbr == "wrong"
    flipped = bytearray(whole)
    flipped[whole.index(b"\xff\xfa") + 8] ^= 1
    assert media.parse(bytes(flipped)).damaged == 1
    one = frame(0xFB, 0x90, 0x00)
    other = frame(0xFD, 0xA4, 0x00)
    s = media.parse(one * 3 + other[:100] + one * 2)
    assert s.frames == 5 and s.resyncs == 1 and s.hertz == 44100


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"ID3\x04\0\0\0\0\x7f\x7f", b"TAG" + bytes(125), b"\xff" * 1000, bytes(1000), b"ID3\x04\0\0\0\0\0\x14TIT2\0\0\0\x7f\0\0\x03abc"])
def test_no_frames(data):
    assert media.parse(data).frames == 0


def test_any_cut_or_flip_parses():
    whole = media.write(media.padded("é" * 700)[0])
    for k in range(0, len(whole), 7):
        media.parse(whole[:k])
        media.parse(whole[k:])
        media.parse(whole[:k] + bytes((whole[k] ^ 0xFF,)) + whole[k + 1 :])


def test_store_and_query(spark, tmp_path):
    rows = [(1, None, "m"), (2, "", "m"), (3, "é" * 900, "m"), (3, "é" * 900, "m"), (None, "x", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    kept = media.store(docs).collect()
    assert len(kept) == 5 and all(r.media.offsets == media.parse(bytes(r.media.bytes)).offsets and r.media.samples == 1152 * len(r.media.offsets) for r in kept)
    assert media.store(docs.limit(0)).count() == 0
    docs.select("doc_id", "text", F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op10_mpeg_audio(spark, str(tmp_path)).collect()
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        data = text.encode()
        data += bytes(-len(data) % 64 or 64 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert len(got) == 5
