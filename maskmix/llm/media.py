"""MPEG audio columns: writing text into MPEG-1 Layer III frames, and parsing streams of layers I to III.

The parser reads tags (ID3v2 in front, with its text frames, and ID3v1 behind), finds the next frame header where
the stream is out of step, reads a Xing, Info or VBRI table as far as its flags and the stream go and checks it
against the frames, verifies each frame's CRC-16 (layers I and III; the protected bits of layer II need its
allocation tables, so its frames are left unchecked), and keeps the exact duration (samples and rate) with the byte
offset of every frame. All frames of a stream have the first one's version, layer and rate; a header with others is
out of step. The writer stores a payload in the frames' main data, whose length the side information gives, at a
variable bitrate.

Defined cases: null text is empty text; bytes without any frame parse to no frames; frames of free bitrate are not
recognised; a damaged frame is counted, and its payload left out; a cut table or tag is read as far as it goes;
repeated rows give equal values; an empty table gives no rows. ``store`` carries other columns along and replaces a
column named like its result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from maskmix.llm.common import documents

# Fixed values of the format: kbit/s by index, by (version 1, layer); Hz of version 1; samples of a frame.
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)
FRAME_SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
RATES_1 = RATES[True, 3]
SAMPLES, SIDE = 1152, 17  # of a mono frame of version 1, layer III
TAG = b"ID3\x04\x00\x00\x00\x00\x00\x12" + b"TSSE\x00\x00\x00\x08\x00\x00\x03maskmix"
END_TAG = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _table()


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    """Of the header's last two bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    length: int
    layer: int
    side: int  # bytes of side information (layer III) or of the bit allocation (layer I); 0 for layer II
    samples: int
    hertz: int
    kbits: int
    protected: bool
    kind: tuple[int, int, int]  # version, layer and rate, equal in all frames of a stream


@functools.lru_cache(4096)
def header(four: bytes) -> Header | None:
    """A frame header, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, hertz, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    first, mode = version == 3, four[3] >> 6
    kbits = RATES[first, layer][rate]
    hz = HERTZ[hertz] >> {3: 0, 2: 1, 0: 2}[version]
    if layer == 1:
        length = (12000 * kbits // hz + pad) * 4
        # Four bits a subband and channel; joint stereo shares them from its bound on.
        channels = {3: 32, 1: 36 + 4 * (four[3] >> 4 & 3)}.get(mode, 64)
        side = channels // 2
    else:
        length = (144000 if first or layer == 2 else 72000) * kbits // hz + pad
        side = 0 if layer == 2 else ((17 if mode == 3 else 32) if first else (9 if mode == 3 else 17))
    return Header(length, layer, side, FRAME_SAMPLES[first, layer], hz, kbits, not four[1] & 1, (version, layer, hz))


@functools.lru_cache(2048)
def _front(used: int, last: bool) -> tuple[bytes, int]:
    """Header, CRC and side information of a frame with so many payload bytes; and the frame's length."""
    for index in range(1, 15) if last else (14,):
        length = 144 * RATES_1[index] * 1000 // HERTZ[0]
        if length - 6 - SIDE >= used:
            break
    head = bytes((0xFF, 0xFA, index << 4, 0xC0))
    # Side information of a mono frame: main_data_begin 9, private 5, scfsi 4 bits; then 59 bits for each of two
    # granules, which begin with part2_3_length, in bits.
    first = min(used, 511) * 8
    bits = (first << 47) << 59 | (used * 8 - first) << 47
    side = bits.to_bytes(SIDE, "big")
    return head + struct.pack(">H", crc16(head[2:] + side)) + side, length


FULL = 144 * 320 * 1000 // HERTZ[0] - 6 - SIDE


def write(payload: bytes) -> bytes:
    """The payload as a tagged stream of variable bitrate."""
    frames, at = [], 0
    while at < len(payload):
        part = payload[at : at + FULL]
        front, length = _front(len(part), len(part) < FULL)
        frames.append((front + part).ljust(length, b"\0"))
        at += FULL
    total, offsets = 208, []
    for f in frames:
        offsets.append(total)
        total += len(f)
    toc = bytes(min(255, offsets[i * len(frames) // 100] * 256 // total) for i in range(100)) if frames else bytes(100)
    info = b"\xff\xfb\x50\xc0" + bytes(SIDE) + b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + struct.pack(">I", 0)
    return b"".join([TAG, info.ljust(208, b"\0"), *frames, END_TAG])


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    hertz: int = 0
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0
    vbr: str = "none"
    tags: list[str] = field(default_factory=list)
    texts: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    payload: bytes = b""


def synchsafe(four: bytes) -> int:
    return functools.reduce(lambda n, b: n << 7 | b & 127, four, 0)


def tag_texts(tag: bytes, version: int) -> dict[str, str]:
    """The text frames of an ID3v2 tag (versions 3 and 4), as far as they are whole."""
    out, at = {}, 0
    while at + 10 <= len(tag) and tag[at : at + 4].isalnum():
        name, size = tag[at : at + 4].decode(), synchsafe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        body = tag[at + 10 : at + 10 + size]
        if name[0] == "T" and body and len(body) == size and body[0] < 4:
            out[name] = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]], "replace").rstrip("\0")
        at += 10 + size
    return out


@dataclass(frozen=True)
class Table:
    """What a table of variable bitrate says; None where it does not."""

    frames: int | None
    size: int | None
    counts_itself: bool  # the table's frame may be among the frames


def table_of(media: bytes, at: int, end: int, h: Header) -> Table | None:
    """The table in the frame at ``at``, if there is one."""
    stop = min(end, at + h.length)

    def number(place: int, size: int) -> int | None:
        return int.from_bytes(media[place : place + size], "big") if place + size <= stop else None

    for front in (4, 6) if h.layer == 3 else ():
        place = at + front + h.side
        if media[place : place + 4] in (b"Xing", b"Info") and place + 8 <= stop:
            flags, place = number(place + 4, 4), place + 8
            frames = number(place, 4) if flags & 1 else None
            size = number(place + 4 * (flags & 1), 4) if flags & 2 else None
            return Table(frames, size, False)
    if h.layer == 3 and media[at + 36 : at + 40] == b"VBRI" and at + 40 <= stop:
        return Table(number(at + 50, 4), number(at + 46, 4), True)
    return None


def parse(media: bytes) -> Stream:
    out, at, end, parts = Stream(), 0, len(media), []
    while media[at : at + 3] == b"ID3" and at + 10 <= end:
        size = synchsafe(media[at + 6 : at + 10])
        out.texts |= tag_texts(media[at + 10 : min(end, at + 10 + size)], media[at + 3])
        at += 10 + size + 10 * bool(media[at + 5] & 16)
        out.tags.append("ID3v2")
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.append("ID3v1")
    start, table, in_step, kind = at, None, True, None
    while at + 4 <= end:
        h = header(media[at : at + 4])
        fits = h is not None and at + h.length <= end and kind in (None, h.kind)
        # Out of step, a header counts only if another of its kind follows it or the stream ends there.
        if fits and not in_step and at + h.length < end:
            then = header(media[at + h.length : at + h.length + 4])
            fits = then is not None and then.kind == h.kind
        if not fits:
            out.resyncs += in_step
            in_step = False
            at = media.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        in_step = True
        if kind is None:
            start, kind, table = at, h.kind, table_of(media, at, end, h)
            if table:
                at += h.length
                continue
        body = at + 4 + 2 * h.protected
        if h.protected and h.side:
            side = media[body : body + h.side]
            good = crc16(media[at + 2 : at + 4] + side) == int.from_bytes(media[at + 4 : at + 6], "big")
            out.checked += good
            out.damaged += not good
            if good and h.layer == 3 and h.side == SIDE and h.samples == SAMPLES:
                bits = int.from_bytes(side, "big")
                used = ((bits >> 106 & 0xFFF) + (bits >> 47 & 0xFFF)) // 8
                parts.append(media[body + h.side : min(body + h.side + used, at + h.length)])
        out.offsets.append(at)
        out.frames += 1
        out.samples += h.samples
        out.hertz = h.hertz
        at += h.length
    if table:
        said = [table.frames in (None, out.frames, *([out.frames + 1] if table.counts_itself else [])), table.size in (None, end - start)]
        out.vbr = "wrong" if not all(said) else "unverified" if table.frames is None and table.size is None else "exact"
    out.payload = b"".join(parts)
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or 64 * (not data)), len(data)


_FIELDS = {"bytes": (T.BinaryType(), pa.binary()), "samples": (T.LongType(), pa.int64()), "hertz": (T.IntegerType(), pa.int32()), "offsets": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}
MEDIA = T.StructType([T.StructField(c, k) for c, (k, _) in _FIELDS.items()])


def store(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """``df`` plus a media column: the stream, its exact duration as samples and rate, and its seek offsets."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, MEDIA)])
    arrow = pa.struct([(c, k) for c, (_, k) in _FIELDS.items()])

    def run(batches):
        for batch in batches:
            made = []
            for x in batch.column(text).to_pylist():
                s = parse(media := write(padded(x)[0]))
                made.append({"bytes": media, "samples": s.samples, "hertz": s.hertz, "offsets": s.offsets})
            keep = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(made, arrow)], [*keep, name])

    return df.mapInArrow(run, schema)


def features(s: Stream) -> str:
    seek = zlib.crc32(struct.pack(f">{len(s.offsets)}Q", *s.offsets))
    return f"frames={s.frames};samples={s.samples};hertz={s.hertz};crc_ok={s.checked};damaged={s.damaged};resyncs={s.resyncs};vbr={s.vbr};tags={'+'.join(s.tags)};seek_crc32={seek}"


OUT = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType() if c in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]])


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of ``store``'s column, each stream read back."""

    def run(batches):
        for batch in batches:
            rows = []
            kept = batch.column("media")
            for doc_id, x, media, offsets in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), kept.field("bytes").to_pylist(), kept.field("offsets").to_pylist(), strict=True):
                s = parse(media)
                if s.offsets != offsets:
                    raise ValueError("the stored offsets are not those of the stream")
                rows.append((doc_id, len((x or "").encode()), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for c, f in zip(cols, OUT.fields, strict=True)], OUT.names)

    return store(documents(spark, sf_dir).select("doc_id", "text")).mapInArrow(run, OUT)
