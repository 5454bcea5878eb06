"""MPEG audio: writing payloads as valid frames, and a reader that resynchronises, parses tags and variable-bitrate tables and verifies checksums.

The writer makes MPEG-1 layer III, mono, 48 kHz, CRC-protected streams of variable bitrate. Their side information is all zero, which decodes to
silence, so that the rest of a frame is ancillary data, which holds the payload. An ID3v2 tag has the payload's size, a Xing frame the numbers of
frames and bytes and a table of seek points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, texts

# Fixed values of the MPEG audio standard: kbit/s by bitrate index 1 to 14, sample rates in Hz by index 0 to 2.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    """CRC-16 by polynomial x^16 + x^15 + x^2 + 1, highest bit first."""
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of a layer III frame's side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_seen: dict[bytes, Header | None] = {}


def header(data: bytes) -> Header | None:
    """What four bytes say, or None if they are no header of a frame of known size."""
    if data in _seen:
        return _seen[data]
    out = None
    if len(data) == 4 and data[0] == 255 and data[1] >> 5 == 7:
        version, layer, kb, rate = {0: 2.5, 2: 2, 3: 1}.get(data[1] >> 3 & 3), 4 - (data[1] >> 1 & 3), data[2] >> 4, data[2] >> 2 & 3
        if version and layer < 4 and 0 < kb < 15 and rate < 3 and data[3] & 3 != 2:
            k, hz, pad = KBITS[1 if version == 1 else 2, layer][kb - 1], RATES[version][rate], data[2] >> 1 & 1
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
            size = (12 * k * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * k * 1000 // hz + pad
            out = Header(version, layer, not data[1] & 1, k, hz, data[3] >> 6 == 3, size, samples)
    if len(_seen) < 4096:
        _seen[data] = out
    return out


@dataclass
class Stream:
    """What the reader found."""

    tags: dict[str, bytes] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of audio frames
    samples: int = 0
    rate: int = 0
    checked: int = 0
    damaged: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag
    declared_frames: int | None = None
    declared_bytes: int | None = None
    toc: tuple[int, ...] = ()
    bodies: list[bytes] = field(default_factory=list)

    @property
    def duration(self) -> tuple[int, int]:
        """Exact seconds, as samples and samples a second."""
        return self.samples, self.rate


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3(data: bytes, tags: dict[str, bytes]) -> int:
    """The end of a tag at the start; its frames go to tags."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at = min(len(data), 10 + _synchsafe(data[6:10])), 10
    while at + 10 <= end and data[at]:
        name, n = data[at : at + 4].decode("latin-1"), _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        tags[name] = data[at + 10 : min(end, at + 10 + n)]
        at += 10 + n
    return end + 10 * bool(data[5] & 16)


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame at `at` holds a Xing or VBRI table instead of sound; what it declares goes to out."""
    x = at + 4 + 2 * h.protected + h.side
    if h.layer == 3 and data[x : x + 4] in (b"Xing", b"Info"):
        flags, x = int.from_bytes(data[x + 4 : x + 8]), x + 8
        for bit, name in ((1, "declared_frames"), (2, "declared_bytes")):
            if flags & bit:
                setattr(out, name, int.from_bytes(data[x : x + 4]))
                x += 4
        if flags & 4:
            out.toc = tuple(data[x : x + 100])
        return True
    x = at + 36
    if h.layer == 3 and data[x : x + 4] == b"VBRI":
        out.declared_bytes, out.declared_frames, n, scale, width = struct.unpack(">IIHHH", data[x + 10 : x + 24])
        out.toc = tuple(int.from_bytes(data[x + 26 + width * i : x + 26 + width * (i + 1)]) * scale for i in range(n))
        return True
    return False


def _declared_end(data: bytes, at: int) -> int | None:
    """Where the sound ends by the byte count of the table in the first frame, if there is one."""
    h, out = header(data[at : at + 4]), Stream()
    return at + out.declared_bytes if h and _table(data, at, h, out) and out.declared_bytes is not None else None


def parse(data: bytes) -> Stream:
    """Read a stream that may have tags, junk between frames, false sync words and a cut end.

    A header counts if another of the same version, layer and rate, or the end or a closing tag, follows where its frame ends; in step
    with the frame before, a right checksum does too. What looks like a closing tag is sound if the declared bytes reach beyond it, to the end.
    """
    out = Stream()
    at = _id3(data, out.tags)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) - 128 >= at and _declared_end(data, at) != len(data) else len(data)
    if end < len(data):
        out.tags["TAG"] = data[-125:]
    step, first = None, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        kind = h and (h.version, h.layer, h.rate)
        if h:
            after = at + h.size
            n = header(data[after : after + 4]) if after + 4 <= end else None
            if not (after == end or n and (n.version, n.layer, n.rate) == kind or kind == step and _sound(data, at, h)):
                h = None
        if not h or at + h.size > end:
            step, found = None, data.find(b"\xff", at + 1, end)
            out.skipped += (end if found < 0 else found) - at
            at = end if found < 0 else found
            continue
        step = kind
        skip = 4 + 2 * h.protected
        if not (first and _table(data, at, h, out)):
            if h.protected and h.layer == 3:
                out.checked += 1
                out.damaged += not _sound(data, at, h)
            out.offsets.append(at)
            out.samples += h.samples
            out.rate = h.rate
            out.bodies.append(data[at + skip + (h.side if h.layer == 3 else 0) : at + h.size])
        first = False
        at += h.size
    out.skipped += end - at
    return out


def _sound(data: bytes, at: int, h: Header) -> bool:
    """Whether a frame's checksum, which layer III has over the header's end and the side information, is right; true where there is none to verify."""
    return not (h.protected and h.layer == 3) or _check(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6])


_checks: dict[bytes, int] = {}


def _check(data: bytes) -> int:
    c = _checks.get(data)
    if c is None:
        c = crc16(data)
        if len(_checks) < 4096:
            _checks[data] = c
    return c


SIDE = bytes(17)
#: Of each bitrate index: header, checksum and zero side information; frame size.
_FRAMES = [(h + _check(h[2:] + SIDE).to_bytes(2) + SIDE, 144 * k // 48) for i, k in enumerate(KBITS[1, 3], 1) for h in [bytes([0xFF, 0xFA, i << 4 | 4, 0xC0])]]


def write(payload: bytes) -> bytes:
    """A stream that holds payload. The last frame has the least bitrate whose frame has room for the rest."""
    head, size = _FRAMES[-1]
    room, frames = size - len(head), []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        if len(part) == room:
            frames.append(head + part)
        else:
            h, n = next(x for x in _FRAMES if x[1] - len(x[0]) >= len(part))
            frames.append(h + part + bytes(n - len(h) - len(part)))
    sound, info = sum(map(len, frames)), _FRAMES[5]
    total = sound + info[1]
    starts = [info[1]]
    for f in frames[:-1]:
        starts.append(starts[-1] + len(f))
    toc = bytes(starts[i * len(frames) // 100] * 256 // total for i in range(100))
    table = info[0] + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    size = len(payload).to_bytes(8)
    priv = b"payload\0" + size
    tag = b"PRIV" + bytes([0, 0, 0, len(priv)]) + b"\0\0" + priv
    return b"ID3\x04\0\0" + bytes([0, 0, 0, len(tag)]) + tag + table + bytes(info[1] - len(table)) + b"".join(frames)


def read(data: bytes) -> tuple[bytes, Stream]:
    """The payload of a stream of write(), and what the reader found on the way."""
    s = parse(data)
    size = int.from_bytes(s.tags["PRIV"].removeprefix(b"payload\0"))
    payload = b"".join(s.bodies)[:size]
    if len(payload) < size:
        raise ValueError(f"{size} bytes declared, {len(payload)} found")
    return payload, s


def payload_of(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def audio_columns(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, media (the stream), duration_samples, sample_rate, frame_offsets and counts of checked, damaged and skipped parts.

    A null or empty text has a payload of 64 zero bytes. A row stays a row; further columns are not read.
    """

    def run(batch: pa.RecordBatch):
        out = {k: [] for k in ("n_bytes", "payload", "media", "duration_samples", "sample_rate", "frame_offsets", "declared_frames", "checked", "damaged", "skipped")}
        for x in texts(batch):
            media = write(payload_of(x))
            payload, s = read(media)
            for k, v in zip(out, (len(x.encode()), payload, media, s.samples, s.rate, s.offsets, s.declared_frames, s.checked, s.damaged, s.skipped), strict=True):
                out[k].append(v)
        yield {"doc_id": batch.column("doc_id")} | out

    kinds = "n_bytes long, payload binary, media binary, duration_samples long, sample_rate int, frame_offsets array<int>, declared_frames int, checked int, damaged int, skipped long"
    return by_batches(df.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {kinds}")


def digest(df: DataFrame) -> DataFrame:
    """Digest columns of audio_columns(), without sending the streams out of the workers.

    Equal texts have equal values; null counts as empty; equal rows stay apart; an empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch):
        out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for x in texts(batch):
            media = write(payload_of(x))
            payload, s = read(media)
            seek = zlib.crc32(struct.pack(f">{len(s.offsets)}I", *s.offsets))
            feature = f"frames={len(s.offsets)}/{s.declared_frames};samples={s.samples}/{s.rate};crc={s.checked - s.damaged}/{s.checked};skipped={s.skipped};toc={zlib.crc32(bytes(s.toc)):08x};seek={seek:08x}"
            for k, v in zip(out, (len(x.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                out[k].append(v)
        yield {"doc_id": batch.column("doc_id")} | out

    return by_batches(df.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
