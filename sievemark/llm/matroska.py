"""Media columns: Matroska audio written and read as EBML, with a table of packets.

Method: variable-length EBML elements are parsed down to clusters; blocks are unlaced (none, Xiph, EBML
and fixed-size lacing) into packets with track, timestamp, byte range and key flag; cues give
the seek points. Every byte of a packet is a range of the file, so nothing is decoded to find it.

Cases: null text is stored as empty; an empty text has one 64-byte packet of zeros; equal texts
give equal files (no dates, no random ids); repeated rows are stored again; other columns of the
input stay out; long texts take more clusters; one file at a time is in memory, a few times over: packets are arrays of
numbers, not objects, and rows go on when they hold ROW_BYTES of files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

UNIT, RATE = 64, 8000
PACKET_MS = UNIT * 1000 // RATE
BLOCK_PACKETS, CLUSTER_BLOCKS = 128, 16
#: Bytes of files in a batch of rows, bytes of samples that are measured at once, and packets in a batch of a table.
ROW_BYTES, PIECE, TABLE_ROWS = 32 << 20, 1 << 20, 1 << 20


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, as short as it can be."""
    if not width:
        width = 1
        while n >= (1 << (7 * width)) - 1:
            width += 1
    return (n | (1 << (7 * width))).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(kind: int, x: float) -> bytes:
    return element(kind, np.array(x, dtype=">f8").tobytes())


def lace(packets: list[bytes], lacing: int) -> bytes:
    """The body of a block after its flags."""
    if lacing == NO_LACING:
        return packets[0]
    sizes, out = [len(p) for p in packets], bytes([len(packets) - 1])
    if lacing == XIPH:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif lacing == EBML_LACING:
        out += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = 1
            while abs(b - a) > (1 << (7 * width - 1)) - 1:
                width += 1
            out += vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return out + b"".join(packets)


def block_head(track: int, shift: int, lacing: int, key: bool = True) -> bytes:
    return vint(track) + shift.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1])


def block(track: int, shift: int, packets: list[bytes], lacing: int, key: bool = True) -> bytes:
    return block_head(track, shift, lacing, key) + lace(packets, lacing)


def write(payload: bytes) -> bytes:
    """8-bit samples of one channel, as a file; the payload is a multiple of 64 bytes."""
    count = len(payload) // UNIT
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, count * PACKET_MS) + element(MUXER, b"sievemark") + element(WRITER, b"sievemark"))
    audio = element(AUDIO, _float(SAMPLING, RATE) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, times = [], []
    per = BLOCK_PACKETS * CLUSTER_BLOCKS
    for first in range(0, count, per):
        body = [uint(TIMESTAMP, first * PACKET_MS)]
        for a in range(first, min(first + per, count), BLOCK_PACKETS):
            b = min(a + BLOCK_PACKETS, first + per, count)
            laced = (bytes([b - a - 1]) if b - a > 1 else b"") + payload[a * UNIT : b * UNIT]  # packets of one size stand as they are
            body.append(element(SIMPLE_BLOCK, block_head(1, (a - first) * PACKET_MS, FIXED if b - a > 1 else NO_LACING) + laced))
        clusters.append(element(CLUSTER, b"".join(body)))
        times.append(first * PACKET_MS)
    # Cues come last: places count from the first byte in the segment.
    place, points = len(info) + len(tracks), b""
    for t, c in zip(times, clusters, strict=True):
        points += element(CUE_POINT, uint(CUE_TIME, t) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, place)))
        place += len(c)
    body = [info, tracks, *clusters, element(CUES, points)]
    return b"".join([head, SEGMENT.to_bytes(4, "big"), vint(sum(map(len, body))), *body])


@dataclass
class Media:
    """What a file holds. laces: of each block its track, its packets' timestamps in ms, first bytes and sizes, and whether it is a key; a block's packets follow each other."""

    laces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    scale: int = 1_000_000
    duration: float = 0.0

    @property
    def packets(self) -> list[tuple[int, int, int, int, bool]]:
        """(track, timestamp in ms, first byte, bytes, key)."""
        return [(track, t, a, n, key) for track, ms, first, size, key in self.laces for t, a, n in zip(ms.tolist(), first.tolist(), size.tolist(), strict=True)]

    def count(self) -> int:
        return sum(len(x[1]) for x in self.laces)


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, place after it, width); -1 for an unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    if keep:
        return raw, at + width, width
    value = raw & ((1 << (7 * width)) - 1)
    return (-1 if value == (1 << (7 * width)) - 1 else value), at + width, width


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, first byte of the body, end) of the elements in a range. One of unknown size ends where an element of its own or a higher level begins."""
    while at < end:
        kind, body, _ = read_vint(data, at, keep=True)
        size, body, _ = read_vint(data, body)
        if size >= 0:
            stop = body + size
            if stop > end:
                raise ValueError(f"element {kind:x} at byte {at} goes past its parent")
        else:
            stop = end
            if kind == CLUSTER:
                probe = body
                while probe < end:
                    inner, after, _ = read_vint(data, probe, keep=True)
                    if inner in (CLUSTER, CUES, INFO, TRACKS, SEGMENT):
                        stop = probe
                        break
                    size, after, _ = read_vint(data, after)
                    probe = after + size
        yield kind, body, stop
        at = stop


def unlace(data: bytes, at: int, end: int, lacing: int) -> tuple[int, np.ndarray]:
    """First byte of a block's packets, and their sizes."""
    if lacing == NO_LACING:
        return at, np.array([end - at])
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("packets of a fixed-size lace differ")
        return at, np.full(count, (end - at) // count)
    elif lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        n, at, _ = read_vint(data, at)
        sizes = [n] if count > 1 else []
        for _ in range(count - 2):
            raw, at, width = read_vint(data, at)
            raw = (1 << (7 * width)) - 1 if raw < 0 else raw
            sizes.append(sizes[-1] + raw - ((1 << (7 * width - 1)) - 1))
    if len(sizes) < count:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError("a lace does not fill its block")
    return at, np.array(sizes)


def read(data: bytes) -> Media:
    """Packets, cues and tracks of a file."""
    out = Media()
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: float(np.frombuffer(data[a:b], dtype=f">f{b - a}")[0])

    def take(a: int, b: int, at_time: int, simple: bool, key: bool) -> None:
        track, a, _ = read_vint(data, a)
        shift, flags = int.from_bytes(data[a : a + 2], "big", signed=True), data[a + 2]
        start = (at_time + shift) * out.scale // 1_000_000
        first, size = unlace(data, a + 3, b, flags >> 1 & 3)
        rate = out.tracks.get(track, {}).get("rate", 0)
        width = out.tracks.get(track, {}).get("bits", 8) * out.tracks.get(track, {}).get("channels", 1) // 8 or 1
        before = np.cumsum(size) - size
        samples = np.cumsum(size // width) - size // width
        ms = start + (samples * 1000 // rate).astype(np.int64) if rate else np.full(len(size), start)
        out.laces.append((track, ms, first + before, size, bool(flags & 0x80) if simple else key))
        out.blocks += 1

    for kind, a, b in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        for part, c, d in elements(data, a, b):
            if part == INFO:
                for x, e, f in elements(data, c, d):
                    if x == TIMESTAMP_SCALE:
                        out.scale = number(e, f)
                    elif x == DURATION:
                        out.duration = real(e, f)
            elif part == TRACKS:
                for x, e, f in elements(data, c, d):
                    found: dict = {}
                    for y, g, h in elements(data, e, f) if x == TRACK_ENTRY else ():
                        if y == TRACK_NUMBER:
                            found["number"] = number(g, h)
                        elif y == CODEC_ID:
                            found["codec"] = data[g:h].decode()
                        elif y == AUDIO:
                            for z, i, j in elements(data, g, h):
                                if z == SAMPLING:
                                    found["rate"] = real(i, j)
                                elif z in (CHANNELS, BIT_DEPTH):
                                    found["channels" if z == CHANNELS else "bits"] = number(i, j)
                    if found:
                        out.tracks[found.get("number", 0)] = found
            elif part == CLUSTER:
                out.clusters.append(c)
                at_time = 0
                for x, e, f in elements(data, c, d):
                    if x == TIMESTAMP:
                        at_time = number(e, f)
                    elif x == SIMPLE_BLOCK:
                        take(e, f, at_time, True, True)
                    elif x == BLOCK_GROUP:
                        inner = {y: (g, h) for y, g, h in elements(data, e, f)}
                        if BLOCK in inner:
                            take(*inner[BLOCK], at_time, False, REFERENCE not in inner)
            elif part == CUES:
                for _, e, f in elements(data, c, d):
                    when, where, track = 0, 0, 0
                    for y, g, h in elements(data, e, f):
                        if y == CUE_TIME:
                            when = number(g, h)
                        elif y == CUE_POSITIONS:
                            for z, i, j in elements(data, g, h):
                                if z == CUE_CLUSTER:
                                    where = a + number(i, j)
                                elif z == CUE_TRACK:
                                    track = number(i, j)
                    out.cues.append((when, track, where))
    return out


def payload(data: bytes, media: Media) -> bytes:
    return b"".join([data[int(first[0]) : int(first[-1] + size[-1])] for _, _, first, size, _ in media.laces])


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def feature(samples: bytes, media: Media) -> str:
    """Counts of the file's parts and of the samples read back."""
    whole = np.frombuffer(samples, dtype=np.uint8)
    total = energy = peak = crossings = 0
    for lo in range(0, len(whole), PIECE):
        x = whole[lo : lo + PIECE].astype(np.int64)
        high = whole[lo : lo + PIECE + 1] >= 128
        total, energy, peak, crossings = total + int(x.sum()), energy + int((x * x).sum()), max(peak, int(x.max())), crossings + int((high[1:] != high[:-1]).sum())
    return f"codec={media.tracks[1]['codec']};rate={int(media.tracks[1]['rate'])};clusters={len(media.clusters)};cues={len(media.cues)};blocks={media.blocks};packets={media.count()};ms={int(media.duration)};sum={total};energy={energy};peak={peak};crossings={crossings}"


def media_columns(documents: DataFrame, with_file: bool = True) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the file (null without with_file)."""

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, done, held = batch["doc_id"], [], 0, 0
            for i, t in enumerate(batch["text"]):
                body, n = padded(t.as_py())
                data = write(body)
                del body
                media = read(data)
                back = payload(data, media)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(back, media), data if with_file else None))
                held += len(data) * with_file
                if held > ROW_BYTES or len(rows) == 2048 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids[done : i + 1], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)
                    rows, done, held = [], i + 1, 0

    docs = documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    return docs.mapInArrow(store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")


def packet_table(files: DataFrame) -> DataFrame:
    """The packets of files(doc_id, media): doc_id, packet, track, timestamp_ms, first_byte, n_bytes, is_key. A null file has none; a damaged one raises."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch["doc_id"].to_pylist(), batch["media"], strict=True):
                laces, done = read(data.as_py()).laces if data.is_valid else [], 0
                per = TABLE_ROWS // 256  # a lace has 256 packets at most
                for lo in range(0, len(laces), per):
                    track, ms, first, size, is_key = zip(*laces[lo : lo + per], strict=True)
                    each = [len(x) for x in ms]
                    n = sum(each)
                    columns = [np.arange(done, done + n), np.repeat(track, each), np.concatenate(ms), np.concatenate(first), np.concatenate(size), np.repeat(is_key, each)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.bool_()], strict=True))], ["doc_id", "packet", "track", "timestamp_ms", "first_byte", "n_bytes", "is_key"])
                    done += n

    return files.selectExpr("cast(doc_id as long) as doc_id", "media").mapInArrow(parse, "doc_id long, packet long, track long, timestamp_ms long, first_byte long, n_bytes long, is_key boolean")
