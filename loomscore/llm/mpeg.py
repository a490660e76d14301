"""MPEG audio columns: parsing, and bytes stored losslessly in Layer III frames.

``parse`` reads any MPEG-1, 2 or 2.5 stream of Layers I to III: it skips and
reads ID3v2 and ID3v1 tags, finds the next frame again after bytes that are
none (a header counts if its frame's checksum holds, or if the frame ends at
another header or the end), reads Xing, Info and VBRI tables, verifies Layer III
checksums, and gives the exact duration and the offset of each audio frame.

``store`` puts bytes into such a stream: after an ID3v2 tag and a Xing table,
frames of 672 bytes (48 kHz, 224 kbit/s) that carry no audio but, behind
their side information, where decoders skip ancillary data, 576 bytes of the
payload each.  A payload is padded with bytes 255 to a positive multiple of
576; the tag holds its length.

Null texts are stored like empty ones; texts are stored whole whatever their
length.  A null stream, and one without frames,
gives no frames, a duration of zero and an empty payload.  Repeated rows get
equal values; other columns stay, those with the names of results are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches

# Fixed values of the MPEG audio header (ISO 11172-3, 13818-3): kbit/s by
# version 1 or 2, layer and index; Hz by version 1 and index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)

UNIT = 576


@dataclass(frozen=True)
class Header:
    size: int
    rate: int
    samples: int
    kbps: int
    layer: int
    side: int
    checked: bool


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """Of four bytes; None if they can't begin a frame (free bit rates are not read)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate, rates = raw[2] >> 2 & 3, raw[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or rates in (0, 15):
        return None
    first = version == 3
    kbps, hz = BITRATES[1 if first else 2, layer][rates], RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    pad, mono = raw[2] >> 1 & 1, raw[3] >> 6 == 3
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(size, hz, samples, kbps, layer, side, not raw[1] & 1)


@lru_cache(maxsize=4096)
def checksum(raw: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005 from 0xFFFF."""
    crc = 0xFFFF
    for byte in raw:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def from_syncsafe(raw: bytes) -> int:
    return sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=False))


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    rate: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""  # Xing, Info or VBRI
    told_frames: int | None = None
    told_bytes: int | None = None
    toc: bytes = b""
    good: int = 0  # frames whose checksum holds
    bad: int = 0
    skipped: int = 0  # bytes that are neither frame nor tag


def read_tag(data: bytes, tags: dict[str, str]) -> int:
    """Bytes of the ID3v2 tag that ``data`` begins with, 0 if none; its user texts go to ``tags``."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end = 10 + from_syncsafe(data[6:10])
    at = 10
    while at + 10 <= min(end, len(data)) and data[at : at + 4].isalnum():
        n = from_syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + n]
        if name[0] == "T" and body[:1] in (b"\x00", b"\x03"):
            text = body[1:].decode("utf-8" if body[0] else "latin-1", "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += 10 + n
    return end + (10 if data[5] & 16 else 0)


def read_table(frame: bytes, h: Header, s: Stream) -> bool:
    """Whether the frame holds a variable-bitrate table in place of audio."""
    at = 4 + 2 * h.checked + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        s.table, flags = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8], "big")
        at += 8
        if flags & 1:
            s.told_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 2:
            s.told_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            s.toc = frame[at : at + 100]
        return True
    if frame[36:40] == b"VBRI":
        s.table = "VBRI"
        s.told_bytes, s.told_frames = struct.unpack_from(">II", frame, 46)
        return True
    return False


def parse(data: bytes) -> Stream:
    s = Stream()
    at, end = read_tag(data, s.tags), len(data)
    if data[-128:-125] == b"TAG" and end >= at + 128:
        end -= 128
    samples: dict[int, int] = {}
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        tested = h is not None and after <= end and h.checked and h.layer == 3
        same = tested and checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")
        if h is None or after > end or not (same or after == end or header(data[after : after + 4])):
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            s.skipped += step - at
            at = step
            continue
        if tested:
            s.good, s.bad = s.good + same, s.bad + (not same)
        if s.offsets or s.table or not read_table(data[at:after], h, s):
            s.offsets.append(at)
            s.sizes.append(h.size)
            s.rate = s.rate or h.rate
            samples[h.rate] = samples.get(h.rate, 0) + h.samples
        at = after
    s.skipped += max(0, end - at)
    s.duration = sum((Fraction(n, r) for r, n in samples.items()), Fraction(0))
    return s


# -- bytes as a stream -------------------------------------------------------


def frame_start(bits: int) -> bytes:
    """Header with checksum (48 kHz, stereo) and empty side information."""
    head = bytes([0xFF, 0xFA, bits << 4 | 1 << 2, 0])
    return head + checksum(head[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)


TABLE_START, FRAME_START = frame_start(5), frame_start(12)  # 64 and 224 kbit/s
TABLE_SIZE, FRAME_SIZE = 192, 672
FILL = bytes(FRAME_SIZE - len(FRAME_START) - UNIT)


def padded(body: bytes) -> bytes:
    return body + b"\xff" * (max(1, -(-len(body) // UNIT)) * UNIT - len(body))


def store(body: bytes) -> bytes:
    """The stream that holds ``body``."""
    payload = padded(body)
    n = len(payload) // UNIT
    text = b"\x03payload\0" + b"%d" % len(body)
    tag = b"TXXX" + syncsafe(len(text)) + bytes(2) + text
    size = TABLE_SIZE + n * FRAME_SIZE
    toc = bytes(min(255, (TABLE_SIZE + n * k // 100 * FRAME_SIZE) * 256 // size) for k in range(100))
    table = TABLE_START + b"Xing" + struct.pack(">III", 7, n, size) + toc
    parts = [b"ID3\x04\0\0" + syncsafe(len(tag)), tag, table, bytes(TABLE_SIZE - len(table))]
    for a in range(0, len(payload), UNIT):
        parts += (FRAME_START, payload[a : a + UNIT], FILL)
    return b"".join([*parts, b"TAG".ljust(127, b"\0"), b"\xff"])


def restore(data: bytes, s: Stream) -> tuple[bytes, int]:
    """The padded payload and its length without padding."""
    a = len(FRAME_START)
    return b"".join([data[o + a : o + a + UNIT] for o, n in zip(s.offsets, s.sizes, strict=True) if n == FRAME_SIZE]), int(s.tags.get("payload") or 0)


# -- columns -----------------------------------------------------------------


def stored(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with the UTF-8 of ``text`` as a stream in ``media``, in place of ``text``."""
    return batches.append(df, text, media, T.BinaryType(), lambda: lambda v: [store(x or b"") for x in v], (text,))


KINDS = {
    "payload": T.BinaryType(),
    "n_bytes": T.LongType(),
    "duration_s": T.DoubleType(),
    "duration_samples": T.LongType(),
    "sample_rate": T.IntegerType(),
    "frame_offsets": T.ArrayType(T.LongType()),
    "table": T.StringType(),
    "table_frames": T.LongType(),
    "crc_good": T.LongType(),
    "crc_bad": T.LongType(),
    "skipped_bytes": T.LongType(),
}


def parsed(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what ``parse`` finds in ``media`` and the payload."""
    keep = [c for c in df.columns if c not in KINDS]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, k) for c, k in KINDS.items())])
    at = keep.index(media)
    arrow = [pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), *[pa.int64()] * 4]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.slices(it):
            rows = []
            for data in b.column(at).to_pylist():
                s = parse(data or b"")
                payload, n = restore(data or b"", s)
                rows.append((payload, n, float(s.duration), int(s.duration * s.rate), s.rate, s.offsets, s.table, s.told_frames, s.good, s.bad, s.skipped))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in rows], a) for k, a in enumerate(arrow))], [*keep, *KINDS])

    return df.select(*keep).mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("samples="), "duration_samples"),
        F.concat(F.lit("hz="), "sample_rate"),
        F.concat(F.lit("frames="), F.size("frame_offsets")),
        F.concat(F.lit("table="), "table"),
        F.concat(F.lit("table_frames="), "table_frames"),
        F.concat(F.lit("crc="), "crc_good", F.lit("/"), F.col("crc_good") + F.col("crc_bad")),
        F.concat(F.lit("skipped="), "skipped_bytes"),
        F.concat(F.lit("first="), F.try_element_at("frame_offsets", F.lit(1))),
        F.concat(F.lit("last="), F.try_element_at("frame_offsets", F.lit(-1))),
    )
    return df.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "duration_s",
        "frame_offsets",
    )
