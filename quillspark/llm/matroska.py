"""Matroska columns: store byte payloads as 8-bit PCM tracks and parse files into packet tables.

The parser reads variable-length EBML elements, clusters of known and unknown size, simple and
grouped blocks, the three kinds of lacing, and cues. Each packet has its track, timestamp and
byte range in the file. The writer makes one mono track of unsigned 8-bit samples.

Defined cases: a null text is empty; a payload is never empty (64 zero bytes at least); equal
texts give equal files; parsing null bytes gives no packet; a truncated file gives the packets
that lie whole inside it; elements that make no sense are passed over, so no bytes are an
error; times beyond 64 bits become the largest number. Repeated rows give repeated results.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element identifiers of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

UNIT = 64
RATE = 8000
#: Samples of a packet, packets laced in a block, blocks of a cluster.
PACKET, LACE, BLOCKS = 512, 8, 32
LATEST = (1 << 63) - 1


def vint(n: int, length: int = 0) -> bytes:
    """A data size as a variable-length integer; the all-ones pattern stays reserved."""
    if not length:
        length = 1
        while n >= (1 << 7 * length) - 1:
            length += 1
    return ((1 << 7 * length) | n).to_bytes(length, "big")


def element(identifier: int, body: bytes) -> bytes:
    return identifier.to_bytes((identifier.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def lace_sizes(sizes: list[int]) -> bytes:
    """EBML lacing of all sizes but the last: the first plain, then biased signed differences."""
    out = [vint(sizes[0])]
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        d, length = now - before, 1
        while not -(1 << (7 * length - 1)) + 1 <= d <= (1 << (7 * length - 1)) - 1:
            length += 1
        out.append(vint(d + (1 << (7 * length - 1)) - 1, length))
    return b"".join(out)


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """A file with the payload as one track of unsigned 8-bit samples; the timestamp unit is one sample period."""
    scale = 1_000_000_000 // rate
    head = element(EBML, b"".join((
        element(EBML_VERSION, b"\x01"), element(EBML_READ_VERSION, b"\x01"), element(EBML_MAX_ID, b"\x04"), element(EBML_MAX_SIZE, b"\x08"),
        element(DOC_TYPE, b"matroska"), element(DOC_TYPE_VERSION, b"\x04"), element(DOC_TYPE_READ_VERSION, b"\x02"),
    )))
    info = element(INFO, element(TIMESTAMP_SCALE, unsigned(scale)) + element(MUXING_APP, b"quillspark") + element(WRITING_APP, b"quillspark") + element(DURATION, struct.pack(">d", len(payload))))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + element(CHANNELS, b"\x01") + element(BIT_DEPTH, b"\x08"))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, b"\x01") + element(TRACK_UID, b"\x01") + element(TRACK_TYPE, b"\x02") + element(FLAG_LACING, b"\x01") + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, at, points = [info, tracks], len(info) + len(tracks), []
    # The distance of a block from its cluster's start is a signed 16-bit number.
    span = PACKET * LACE * min(BLOCKS, 32767 // (PACKET * LACE))
    for start in range(0, len(payload), span):
        blocks = [element(CLUSTER_TIMESTAMP, unsigned(start))]
        for first in range(start, min(start + span, len(payload)), PACKET * LACE):
            data = payload[first : min(first + PACKET * LACE, start + span)]
            sizes = [min(PACKET, len(data) - x) for x in range(0, len(data), PACKET)]
            lacing = b"" if len(sizes) == 1 else bytes([len(sizes) - 1]) + lace_sizes(sizes)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", first - start) + bytes([0x80 | (0x06 if lacing else 0)]) + lacing + data))
        body.append(element(CLUSTER, b"".join(blocks)))
        points.append(element(CUE_POINT, element(CUE_TIME, unsigned(start)) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER_POSITION, unsigned(at)))))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(points)))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, next position, length); value -1 for the reserved unknown size."""
    if at >= len(data):
        raise EOFError
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise EOFError
    n = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return n, at + length, length
    n -= 1 << 7 * length
    return (-1 if n == (1 << 7 * length) - 1 else n), at + length, length


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict = field(default_factory=dict)  # number -> (codec, type)
    packets: list = field(default_factory=list)  # (track, timestamp in ns, start, end, keyframe, cluster, lacing)
    cues: list = field(default_factory=list)  # (time in ns, track, absolute position of the cluster)


#: What reading past the end of damaged bytes raises.
DAMAGE = (EOFError, IndexError, struct.error)


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(identifier, body start, body end as stated, open): an element of unknown size is open and ends where its parent does."""
    while at < end:
        try:
            identifier, at, _ = read_vint(data, at, keep_marker=True)
            n, at, _ = read_vint(data, at)
        except EOFError:
            return
        stop = end if n < 0 else at + n
        yield identifier, at, stop, n < 0
        at = stop


def _parts(data: bytes, at: int, end: int) -> dict[int, tuple[int, int]]:
    """The children by identifier; those that lie whole inside, and blocks in any case."""
    end = min(end, len(data))
    return {k: (a, b) for k, a, b, _ in _children(data, at, end) if b <= end or k == BLOCK}


def _lace(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """(sizes of the packets, where the first one starts) of a block's body from `at` on."""
    if not kind:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            v, at, length = read_vint(data, at)
            size = v if k == 0 else sizes[-1] + v - ((1 << (7 * length - 1)) - 1)
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def _block(data: bytes, at: int, end: int, simple: bool, cluster_time: int, cluster: int, media: Media, duration: int | None) -> None:
    try:
        track, at, _ = read_vint(data, at)
        (offset,) = struct.unpack_from(">h", data, at)
        flags = data[at + 2]
        kind = flags >> 1 & 3
        sizes, at = _lace(data, at + 3, end, kind)
    except DAMAGE:
        return
    # Packets of a lace share the block's timestamp unless the samples or a duration tell more.
    codec, _, rate, width = media.tracks.get(track, ("", 0, 0, 0))
    time = (cluster_time + offset) * media.scale
    for size in sizes:
        if size < 0 or at + size > min(end, len(data)):
            return
        media.packets.append((track, min(time, LATEST), at, at + size, bool(flags & 0x80) if simple else True, cluster, kind))
        time += size * 1_000_000_000 // (rate * width) if codec.startswith("A_PCM") and rate * width > 0 else (duration or 0) * media.scale // len(sizes)
        at += size


def parse(data: bytes) -> Media:
    """All packets, tracks and cues of a file."""
    media = Media()

    def number(span: tuple[int, int] | None, default: int = 0) -> int:
        return int.from_bytes(data[slice(*span)], "big") if span else default

    def real(span: tuple[int, int] | None) -> int:
        raw = data[slice(*span)] if span else b""
        x = struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if len(raw) in (4, 8) else 0.0
        return int(x) if 0 <= x < 2**31 else 0

    def cluster_body(start: int, end: int, is_open: bool, position: int) -> None:
        time = 0
        for k, a, b, _ in _children(data, start, end):
            if is_open and k in TOP_LEVEL:
                return
            if k == CLUSTER_TIMESTAMP and b <= end:
                time = number((a, b))
            elif k == SIMPLE_BLOCK:
                _block(data, a, b, True, time, position, media, None)
            elif k == BLOCK_GROUP:
                parts = _parts(data, a, b)
                if BLOCK in parts:
                    _block(data, *parts[BLOCK], False, time, position, media, number(parts.get(BLOCK_DURATION)))

    def track_entry(a: int, b: int) -> None:
        parts = _parts(data, a, b)
        if TRACK_NUMBER in parts:
            sound = _parts(data, *parts[AUDIO]) if AUDIO in parts else {}
            width = number(sound.get(BIT_DEPTH)) // 8 * number(sound.get(CHANNELS), 1)
            codec = data[slice(*parts[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in parts else ""
            media.tracks[number(parts[TRACK_NUMBER])] = (codec, number(parts.get(TRACK_TYPE)), real(sound.get(SAMPLING_FREQUENCY)), width)

    def cue_point(a: int, b: int, start: int) -> None:
        time = number(_parts(data, a, b).get(CUE_TIME))
        for j, x, y, _ in _children(data, a, min(b, len(data))):
            parts = _parts(data, x, y) if j == CUE_TRACK_POSITIONS else {}
            if CUE_TRACK in parts and CUE_CLUSTER_POSITION in parts:
                media.cues.append((min(time * media.scale, LATEST), min(number(parts[CUE_TRACK]), LATEST), min(start + number(parts[CUE_CLUSTER_POSITION]), LATEST)))

    def segment(start: int, end: int) -> None:
        at = start
        while at < end:
            position = at
            try:
                k, at, _ = read_vint(data, at, keep_marker=True)
                n, at, _ = read_vint(data, at)
            except EOFError:
                return
            stop = end if n < 0 else min(at + n, end)
            if k == INFO:
                media.scale = number(_parts(data, at, stop).get(TIMESTAMP_SCALE), media.scale)
            elif k == CLUSTER:
                if n < 0:
                    stop = _end_of_open(data, at, end)
                cluster_body(at, stop, n < 0, position)
            elif k in (TRACKS, CUES):
                for i, a, b, _ in _children(data, at, stop):
                    if i == TRACK_ENTRY:
                        track_entry(a, min(b, stop))
                    elif i == CUE_POINT:
                        cue_point(a, min(b, stop), start)
            at = stop

    for k, a, b, _ in _children(data, 0, len(data)):
        if k == SEGMENT:
            segment(a, min(b, len(data)))
    return media


def _end_of_open(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next top-level element."""
    while at < end:
        try:
            k, body, _ = read_vint(data, at, keep_marker=True)
            n, body, _ = read_vint(data, body)
        except EOFError:
            return end
        if k in TOP_LEVEL:
            return at
        if n < 0:
            return end
        at = body + n
    return end


def packets(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id_col, packet, track, codec, timestamp_ns, start, end, keyframe, cluster, lacing, has_cue): one row for each packet."""

    def read(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(11)]
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = parse(data or b"")
                cued = {c[2] for c in m.cues}
                for k, (track, time, start, end, key_frame, cluster, lacing) in enumerate(m.packets):
                    for c, v in zip(rows, (key, k, track, m.tracks.get(track, ("",))[0], time, start, end, key_frame, cluster, lacing, cluster in cued), strict=True):
                        c.append(v)
            types = [b.schema[0].type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["id", "packet", "track", "codec", "timestamp_ns", "start", "end", "keyframe", "cluster", "lacing", "has_cue"])

    kind = media.schema[id_col].dataType.simpleString()
    return (
        media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
        .mapInArrow(read, f"id {kind}, packet long, track long, codec string, timestamp_ns long, start long, end long, keyframe boolean, cluster long, lacing int, has_cue boolean")
        .withColumnRenamed("id", id_col)
    )


PACKET_FIELDS, CUE_FIELDS = ("track", "timestamp_ns", "start", "end", "cluster"), ("timestamp_ns", "track", "cluster")


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def describe(samples: bytes, n_packets: int) -> str:
    """Packets, mean, root mean square about 128 and crossings of 128 of unsigned 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"{n_packets}:{int(x.sum()) / len(x) + 128:.6f}:{float(int((x * x).sum()) / len(x)) ** 0.5:.6f}:{crossings}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every text as a Matroska file, read it back, and describe what was read.

    (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, n_packets, n_cues, duration_ns, packets, cues), and the file itself in `media` if
    asked for. packets is the file's packet table (track, timestamp_ns, start, end, cluster), and
    cues its cue table (timestamp_ns, track, cluster), as they were read back.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_cues", "duration_ns", "packets", "cues"] + ["media"] * keep_media

    def nested(rows: list[list[tuple]], fields: tuple[str, ...]) -> pa.Array:
        flat = list(zip(*(r for own in rows for r in own), strict=True)) or [()] * len(fields)
        structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], names=list(fields))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(own) for own in rows]))), pa.int32()), structs)

    def read(batches):
        for b in batches:
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                rows: list[list] = [[] for _ in names]
                for text in cut.column(1):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    stored = mux(payload_of(raw))
                    m = parse(stored)
                    back = b"".join(stored[p[2] : p[3]] for p in m.packets)
                    values = [None, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(back, len(m.packets)), len(m.packets), len(m.cues), len(back) * 1_000_000_000 // RATE, [(*p[:4], p[5]) for p in m.packets], m.cues]
                    for c, v in zip(rows, values + [stored] * keep_media, strict=True):
                        c.append(v)
                kinds = [*[pa.int64()] * 2, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3]
                columns = [cut.column(0), *(pa.array(r, t) for r, t in zip(rows[1:11], kinds, strict=True)), nested(rows[11], PACKET_FIELDS), nested(rows[12], CUE_FIELDS)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(r, pa.binary()) for r in rows[13:]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long, duration_ns long, " + ", ".join(
        f"{name} array<struct<{','.join(f'{f}:long' for f in fields)}>>" for name, fields in (("packets", PACKET_FIELDS), ("cues", CUE_FIELDS))
    )
    schema += ", media binary" * keep_media
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(read, schema).withColumnRenamed("id", id_col)
