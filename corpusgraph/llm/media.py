"""MPEG audio columns: bytes stored as a stream of audio frames, and streams read back.

A stream is an ID3v2 tag, a frame with a variable-bitrate table (``Xing``), and audio frames with
checksums.  The frames made here are silent ones of layer III whose ancillary part, which players
skip, carries the bytes.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import documents

#: Bytes of payload in a frame, and the byte that fills the last one.
UNIT, FILL = 192, b" "

# Fixed values of the MPEG audio format: kbit/s by (MPEG-1?, layer), Hz by version bits, samples a frame.
_KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    """What the four bytes at the start of a frame say."""

    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    checked: bool
    kbits: int
    hertz: int
    mono: bool
    length: int
    samples: int
    side: int

    @property
    def stream(self) -> tuple:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.hertz


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The header in a big-endian 32-bit number; None if it is none (or of free bitrate)."""
    if word not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        _headers[word] = _parse_header(word)
    return _headers[word]


def _parse_header(word: int) -> Header | None:
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, frequency = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or frequency == 3 or word & 3 == 2:
        return None
    kbits, hertz = _KBITS[version == 3, layer][rate], _HERTZ[version][frequency]
    padding, mono = word >> 9 & 1, word >> 6 & 3 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    if layer == 1:
        length = (12_000 * kbits // hertz + padding) * 4
    else:
        length = samples * 125 * kbits // hertz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, kbits, hertz, mono, length, samples, side)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint16) << np.uint16(8)
    for _ in range(8):
        table = np.where(table & 0x8000, (table << np.uint16(1)) ^ np.uint16(0x8005), table << np.uint16(1)).astype(np.uint16)
    return table


_CRC = _crc_table()


def frame_crc(covered: np.ndarray) -> np.ndarray:
    """The 16-bit checksums of rows of bytes: the header's last two and the side information."""
    crc = np.full(len(covered), 0xFFFF, np.uint16)
    for column in covered.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)).astype(np.uint8) ^ column]
    return crc


# The frames written here: MPEG-1 layer III, 80 kbit/s, 48 kHz, mono, with checksum; 240 bytes.
_WORD = 0xFFE00000 | 3 << 19 | 1 << 17 | 0 << 16 | 6 << 12 | 1 << 10 | 3 << 6
_START = 4 + 2 + 17


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """*payload*, a positive multiple of UNIT bytes, as an MPEG audio stream."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"payload must be a positive multiple of {UNIT} bytes")
    head = header(_WORD)
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, head.length), np.uint8)
    frames[:, :4] = np.frombuffer(_WORD.to_bytes(4, "big"), np.uint8)
    crc = frame_crc(np.concatenate([frames[:1, 2:4], frames[:1, 6:_START]], axis=1))[0]
    frames[:, 4:6] = np.frombuffer(int(crc).to_bytes(2, "big"), np.uint8)
    table = struct.pack(">4sIII", b"Xing", 7, n, frames.size) + bytes(min(255, 256 * i // 100) for i in range(100))
    frames[0, _START : _START + len(table)] = np.frombuffer(table, np.uint8)
    frames[1:, _START : _START + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    text = b"\0payload\0" + str(len(payload)).encode()
    tag = struct.pack(">4sIH", b"TXXX", len(text), 0) + text
    return b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag + frames.tobytes()


class VbrTable(NamedTuple):
    """What the first frame of a stream of variable bitrate says of it: a ``Xing``, ``Info`` or ``VBRI`` table.

    ``seek`` has byte places from the start of the audio on, in even steps of time (of *step* frames, or a 100th of the
    whole where that is 0).  ``delay`` and ``padding`` are samples that the encoder put before and after the sound.
    """

    kind: str
    frames: int
    bytes: int
    quality: int | None = None
    seek: tuple[int, ...] = ()
    step: int = 0
    delay: int = 0
    padding: int = 0


def _vbr(frame: bytes, head: Header) -> VbrTable | None:
    """The table in a first frame, if it has one; what a cut-off one lacks is 0 or missing."""
    body = frame[4 + 2 * head.checked + head.side :]
    if body[:4] in (b"Xing", b"Info") and len(body) >= 8:
        flags, at = int.from_bytes(body[4:8], "big"), 8
        found: list[bytes] = []
        for bit, size in ((1, 4), (2, 4), (4, 100), (8, 4)):
            found.append(body[at : at + size] if flags & bit else b"")
            at += size * bool(flags & bit)
        frames, size, quality = (int.from_bytes(found[i], "big") for i in (0, 1, 3))
        encoder = body[at : at + 24]
        gaps = int.from_bytes(encoder[21:24], "big") if len(encoder) == 24 and encoder[:4] in (b"LAME", b"Lavf", b"Lavc") else 0
        seek = tuple(x * size // 256 for x in found[2])
        return VbrTable(body[:4].decode(), frames, size, quality if found[3] else None, seek, 0, gaps >> 12, gaps & 0xFFF)
    body = frame[36:]
    if body[:4] == b"VBRI" and len(body) >= 26:
        _, delay, quality, size, frames, entries, scale, width, step = struct.unpack_from(">HHHIIHHHH", body, 4)
        steps = [int.from_bytes(body[26 + width * i : 26 + width * (i + 1)], "big") * scale for i in range(entries) if width and 26 + width * (i + 1) <= len(body)]
        return VbrTable("VBRI", frames, size, quality, tuple(itertools.accumulate(steps, initial=0)) if steps else (), step, delay)
    return None


@dataclass
class Stream:
    """What reading a stream finds."""

    tags: dict[str, str] = field(default_factory=dict)
    head: Header | None = None
    vbr: VbrTable | None = None
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    samples: int = 0
    skipped: int = 0
    checked: int = 0
    bad_crc: int = 0
    payload: bytes = b""

    @property
    def micros(self) -> int:
        """The exact duration in millionths of a second, rounded down, without what the encoder added."""
        return self.samples * 1_000_000 // self.head.hertz if self.head else 0


def _number(data: bytes, bits: int = 8) -> int:
    """A big-endian number of bytes that hold *bits* bits each."""
    out = 0
    for x in data:
        out = out << bits | x & (1 << bits) - 1
    return out


def _text(value: bytes) -> list[str]:
    """The strings of a text field, by the encoding that its first byte names."""
    kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0]] if value[:1] and value[0] < 4 else "latin-1"
    return value[1:].decode(kind, "replace").rstrip("\0").split("\0")


def _fields(data: bytes, version: int, unsynchronised: bool) -> Iterator[tuple[str, bytes]]:
    """Names and values of an ID3v2 tag's fields: sizes are plain in version 3, of 7 bits a byte in 4, and both
    names and sizes have 3 bytes in 2."""
    wide = 3 if version == 2 else 4
    top = 6 if version == 2 else 10
    at = 0
    while at + top <= len(data) and data[at]:
        n = _number(data[at + wide : at + 2 * wide], 7 if version == 4 else 8)
        value = data[at + top : at + top + n]
        if version == 4:
            flags = data[at + 9]
            value = value[4:] if flags & 1 else value  # the length before compression or escapes
            if flags & 2 or unsynchronised:
                value = value.replace(b"\xff\0", b"\xff")
        yield data[at : at + wide].decode("latin-1"), value
        at += top + n


#: Names of text fields in version 2 and from 3 on.
_LONG_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TXX": "TXXX", "TCO": "TCON", "TEN": "TENC", "TLE": "TLEN"}


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """The text fields of the tags in front (ID3v2.2 to 2.4), and where audio starts."""
    tags, start, end = {}, 0, len(data)
    while data[start : start + 3] == b"ID3" and end >= start + 10:
        version, flags = data[start + 3], data[start + 5]
        stop = min(end, start + 10 + _number(data[start + 6 : start + 10], 7))
        body = data[start + 10 : stop]
        if flags & 128 and version < 4:
            body = body.replace(b"\xff\0", b"\xff")
        if flags & 64 and version > 2:  # an extended header, whose size counts itself in version 4 only
            body = body[_number(body[:4], 7) if version == 4 else 4 + _number(body[:4]) :]
        for name, value in _fields(body, version, bool(flags & 128)) if 2 <= version <= 4 else ():
            name = _LONG_NAMES.get(name, name)
            if name[:1] == "T" and value:
                strings = _text(value)
                key, strings = (strings[0], strings[1:]) if name == "TXXX" else (name, strings)
                tags[key] = "/".join(strings)
        start = min(end, stop + 10 * (version == 4 and bool(flags & 16)))
    return tags, start


def read_stream(data: bytes) -> Stream:
    """Walk the frames of a stream; what is no frame is skipped up to the next one.

    A header counts where the frame after it starts with one of the same stream, or the data end
    with it, so that chance sync bits in between are passed over.  What looks like an ID3v1 tag 128 bytes
    before the end is one unless such a frame holds these bytes.  Broken and empty data give what can be found.
    """
    out = Stream()
    out.tags, at = _tags(data)
    end = len(data)
    tag = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    unpack = struct.Struct(">I").unpack_from
    offsets: list[int] = []
    heads: list[Header] = []
    known = False
    while at + 4 <= end:
        head = header(unpack(data, at)[0])
        if head is not None and (out.head is None or head.stream == out.head.stream):
            after = at + head.length
            good = known and after <= end and not at < tag < after
            if not good and after <= end:
                follow = header(unpack(data, after)[0]) if after + 4 <= end else None
                good = after in (tag, end) or follow is not None and follow.stream == head.stream
            if good:
                out.head, known = out.head or head, True
                offsets.append(at)
                heads.append(head)
                at = after
                tag = tag if at <= tag else end
                continue
        known = False
        found = data.find(b"\xff", at + 1, tag)
        out.skipped += (tag if found < 0 else found) - at
        at = tag if found < 0 else found
        if at == tag:
            break
    if tag < end and at == tag:
        end = tag
        out.tags.setdefault("TIT2", data[tag + 3 : tag + 33].decode("latin-1").rstrip("\0 "))
    out.skipped += end - at
    bytes_ = np.frombuffer(data, np.uint8)
    starts = np.array(offsets, np.int64)
    out.offsets = starts
    for head in set(heads):
        if not head.checked or head.layer != 3:
            continue  # the checksums of layers I and II cover a number of bits that depends on the tables
        own = starts if len(set(heads)) == 1 else starts[[h is head for h in heads]]
        covered = own[:, None] + np.array([2, 3, *range(6, 6 + head.side)])
        stored = bytes_[own + 4].astype(np.uint16) << np.uint16(8) | bytes_[own + 5]
        out.checked += len(own)
        out.bad_crc += int((frame_crc(bytes_[covered]) != stored).sum())
    if heads:
        out.vbr = _vbr(data[offsets[0] : offsets[0] + heads[0].length], heads[0])
        if out.vbr:
            offsets, heads, out.offsets = offsets[1:], heads[1:], starts[1:]
    out.samples = sum(h.samples for h in heads)
    if out.vbr:
        out.samples = max(0, out.samples - out.vbr.delay - out.vbr.padding)
    size = out.tags.get("payload", "")
    if heads and size.isdigit() and len(set(heads)) == 1:
        at = 4 + 2 * heads[0].checked + heads[0].side
        rows = out.offsets[:, None] + np.arange(at, at + UNIT)
        out.payload = bytes_[rows].tobytes()[: int(size)] if rows.max(initial=0) < len(bytes_) else b""
    return out


def _parts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of some MB, or of one row, whose last columns hold large values."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in itertools.pairwise(cuts))


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each text's UTF-8, filled up with spaces, as a stream.

    Null and empty texts are one unit of spaces, and texts of any length are stored whole.  Each row is stored by itself, where it lies;
    repeated rows are stored alike.  Other columns are not read.  An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            media = [write_stream(t.ljust(UNIT * max(1, -(-len(t) // UNIT)), FILL)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FOUND = (
    "payload binary, hertz int, frames long, samples long, micros long, skipped long, bad_crc long, vbr_frames long, "
    "seek array<long>"
)


def read_media(stored: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns *keep* of *stored* and what its streams (``media``) hold: the payload, the exact duration
    in samples and microseconds, and each frame's offset.  A null stream is an empty one, repeated rows are read
    alike, an empty table gives no row, and a stream of any length is read whole."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                s = read_stream(data or b"")
                hertz = s.head.hertz if s.head else None
                vbr = s.vbr[1] if s.vbr else None
                rows.append((s.payload, hertz, len(s.offsets), s.samples, s.micros, s.skipped, s.bad_crc, vbr, s.offsets))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [pa.binary(), pa.int32()] + [pa.int64()] * 6 + [pa.list_(pa.int64())]
            found = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "media")), *found], [*keep, "media", *names])

    kinds = dict(stored.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keep, "media")) + ", " + _FOUND
    return stored.select(*keep, "media").mapInArrow(run, schema)


def op5_media_columns(spark, sf_dir):
    read = read_media(store_media(documents(spark, sf_dir)), ("doc_id", "n_bytes"))
    feature = F.format_string(
        "mpeg %d Hz frames=%d vbr=%d samples=%d us=%d skipped=%d bad=%d seek=%s",
        "hertz", "frames", "vbr_frames", "samples", "micros", "skipped", "bad_crc",
        F.md5(F.array_join(F.col("seek").cast("array<string>"), ",").cast("binary")),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
