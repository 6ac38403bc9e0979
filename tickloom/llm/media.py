"""Media columns: Matroska files in a binary column.

``mux`` stores 8-bit samples as an audio track of a Matroska file (EBML header, Segment, Info, Tracks, Clusters of laced SimpleBlocks, Cues). ``packets`` parses any Matroska bytes into a packet table: variable-length elements (unknown sizes included), clusters, block groups, the three kinds of lacing, and cues.

Everything is local to a row; a task holds one Arrow batch. Null media count as empty bytes and give no packets; bytes that are not Matroska, or break off, give the packets that are whole and an ``error`` text. Repeated rows give repeated results; other columns of the input are not read.
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

from .common import apart, bounded_batches, utf8

# Element ids of the format.
EBML = 0x1A45DFA3
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEGMENT}

SAMPLE_RATE = 8000
FRAME = 512  # samples in a frame: 64 ms
LACED = 8  # frames in a block
BLOCKS = 16  # blocks in a cluster: 8.2 s, well inside a block's 16-bit relative timestamp


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length size: the leading bit tells the width; all value bits set would mean 'unknown'."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(eid: int, body: bytes) -> bytes:
    return _id(eid) + _size(len(body)) + body


def _uint(eid: int, n: int) -> bytes:
    return _element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing kind and the bytes after a block's header."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    head = bytes([len(frames) - 1])
    if len({len(f) for f in frames}) == 1:
        return FIXED, head + b"".join(frames)
    sizes = [len(f) for f in frames[:-1]]
    coded = _size(sizes[0])
    for before, now in zip(sizes, sizes[1:]):
        for width in range(1, 9):  # signed differences, offset by half the range
            bias = (1 << (7 * width - 1)) - 1
            if -bias <= now - before <= bias:
                coded += _size(now - before + bias, width)
                break
    return EBML_LACING, head + coded + b"".join(frames)


def mux(samples: bytes, rate: int = SAMPLE_RATE, frame: int = FRAME) -> bytes:
    """A Matroska file with one track of 8-bit PCM samples; the same samples always give the same bytes."""
    header = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / rate)) + _element(MUXING_APP, b"tickloom") + _element(WRITING_APP, b"tickloom"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", float(rate))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, per = bytearray(info + tracks), [], frame * LACED
    for start in range(0, len(samples), per * BLOCKS):
        stamp = start * 1000 // rate
        blocks = [_uint(TIMESTAMP, stamp)]
        for at in range(start, min(len(samples), start + per * BLOCKS), per):
            piece = samples[at : at + per]
            kind, data = _lace([piece[i : i + frame] for i in range(0, len(piece), frame)])
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at * 1000 // rate - stamp, 0x80 | kind << 1) + data))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, stamp) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, len(body)))))
        body += _element(CLUSTER, b"".join(blocks))
    body += _element(CUES, b"".join(cues))
    return header + _id(SEGMENT) + _size(len(body), 8) + bytes(body)


@dataclass
class Parsed:
    """What a file holds. Packets: (track, timestamp_ns, first byte, bytes, keyframe, lacing, duration_ns or None)."""

    doc_type: str = ""
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int | None]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0
    error: str = ""


def _vint(b: bytes, at: int, keep: bool) -> tuple[int, int]:
    """(value, next position); -1 for an unknown size. ``keep``: with the marker bit, as ids have it."""
    first = b[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(b):
        raise ValueError(f"broken number at byte {at}")
    n = int.from_bytes(b[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def _frames(b: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of the frames in a block's data."""
    if at > end:
        raise ValueError(f"a block without its header before byte {end}")
    if lacing == NO_LACING:
        return [(at, end - at)]
    n, at = b[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError(f"{end - at} bytes can't be laced evenly in {n} frames")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while True:
                    step, at = b[at], at + 1
                    size += step
                    if step < 255:
                        break
            else:
                was = at
                size, at = _vint(b, at, False)
                if k:
                    size = sizes[-1] + size - ((1 << (7 * (at - was) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0:
            raise ValueError(f"a frame of {size} bytes at byte {at}")
        out.append((at, size))
        at += size
    return out


def parse(b: bytes) -> Parsed:
    """All of a file's packets; after an error, those before it."""
    out = Parsed()
    try:
        if len(b) < 4 or b[:4] != _id(EBML):
            raise ValueError("no EBML header")
        _walk(b, 0, len(b), 0, out, {})
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        out.error = str(e) or type(e).__name__
    return out


#: Elements inside one another beyond which a file is broken; the format's own go 6 deep.
DEEPEST = 32


def _grouped(packets: list, start: int, group: dict, scale: int) -> None:
    """What a block group says about its packets from ``start`` on: a reference to another block makes them no keyframes; its duration is shared by its frames."""
    own = packets[start:]
    for k, p in enumerate(own):
        duration = group["duration"] * scale // len(own) if group["duration"] is not None else p[6]
        packets[start + k] = (*p[:4], not group["refers"], p[5], duration if duration is None or duration < 1 << 63 else None)


def _walk(b: bytes, at: int, end: int, parent: int, out: Parsed, state: dict, depth: int = 0) -> int:
    if depth > DEEPEST:
        raise ValueError(f"elements nested too deep at byte {at}")
    depth += 1
    while at < end:
        began = at
        eid, at = _vint(b, at, True)
        size, at = _vint(b, at, False)
        if state.get("open") == parent and eid in TOP_LEVEL:
            return began  # an element of unknown size ends where one of its parent's level begins
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {eid:x} at byte {began} runs past its parent")
        body = b[at:stop] if stop - at <= 64 else b""
        if eid == SEGMENT:
            state["segment"] = at
            at = _walk(b, at, stop, SEGMENT, out, state, depth)
            continue
        if eid == EBML:
            _walk(b, at, stop, EBML, out, state, depth)
        elif eid == CLUSTER:
            inner = {"segment": state.get("segment", 0), "cluster": 0} | ({"open": CLUSTER} if size < 0 else {})
            at = _walk(b, at, stop, CLUSTER, out, inner, depth)
            continue
        elif eid == TRACK_ENTRY:
            track: dict = {"type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "default_ns": 0}
            _walk(b, at, stop, eid, out, {"track": track}, depth)
            out.tracks[track.pop("number", 0)] = track
        elif eid == CUE_POINT:
            cue: dict = {}
            _walk(b, at, stop, eid, out, {"cue": cue}, depth)
            out.cues.append((cue.get("time", 0), cue.get("track", 0), cue.get("cluster", 0)))
        elif eid == BLOCK_GROUP:
            group, start = {"refers": False, "duration": None}, len(out.packets)
            try:
                _walk(b, at, stop, eid, out, state | {"group": group}, depth)
            finally:
                _grouped(out.packets, start, group, out.scale)
        elif eid in MASTERS:
            _walk(b, at, stop, eid, out, state, depth)
        elif eid in (SIMPLE_BLOCK, BLOCK):
            track, p = _vint(b, at, False)
            rel, flags = struct.unpack_from(">hB", b, p)
            lacing = flags >> 1 & 3
            step = out.tracks.get(track, {}).get("default_ns", 0)
            stamp = (state.get("cluster", 0) + rel) * out.scale
            frames = _frames(b, p + 3, stop, lacing)
            if not -(1 << 63) <= stamp <= stamp + len(frames) * step < 1 << 63:
                raise ValueError(f"the timestamp of the block at byte {began} is beyond 64 bits")
            for k, (first, n) in enumerate(frames):
                out.packets.append((track, stamp + k * step, first, n, bool(flags & 0x80) or eid == BLOCK, lacing, step or None))
        elif eid == TIMESTAMP:
            state["cluster"] = int.from_bytes(body, "big")
        elif eid == TIMESTAMP_SCALE:
            out.scale = int.from_bytes(body, "big")
        elif eid == DURATION:
            out.duration = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
        elif eid == DOC_TYPE:
            out.doc_type = body.decode("ascii", "replace")
        elif eid == REFERENCE_BLOCK and "group" in state:
            state["group"]["refers"] = True
        elif eid == BLOCK_DURATION and "group" in state:
            state["group"]["duration"] = int.from_bytes(body, "big")
        elif "track" in state:
            track = state["track"]
            if eid == TRACK_NUMBER:
                track["number"] = int.from_bytes(body, "big")
            elif eid == TRACK_TYPE:
                track["type"] = int.from_bytes(body, "big")
            elif eid == CODEC_ID:
                track["codec"] = body.decode("ascii", "replace")
            elif eid == DEFAULT_DURATION:
                track["default_ns"] = int.from_bytes(body, "big")
            elif eid == CHANNELS:
                track["channels"] = int.from_bytes(body, "big")
            elif eid == BIT_DEPTH:
                track["bits"] = int.from_bytes(body, "big")
            elif eid == SAMPLING_FREQUENCY:
                track["rate"] = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
        elif "cue" in state:
            name = {CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER_POSITION: "cluster"}.get(eid)
            if name:
                state["cue"][name] = int.from_bytes(body, "big")
        at = stop
    return at


def features(media: bytes, found: Parsed) -> str:
    """Codec, rate, packet and cue counts, duration, and the samples' mean and spread, from what was read back."""
    if not found.tracks:
        return f"none;error={found.error}"
    t = found.tracks[min(found.tracks)]
    x = np.concatenate([np.frombuffer(media, np.uint8, n, at) for _, _, at, n, *_ in found.packets]) if found.packets else np.zeros(0, np.uint8)
    mean, spread = (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)
    laced = sum(1 for p in found.packets if p[5])
    last = max((p[1] for p in found.packets), default=0) // 1_000_000
    return f"{t['codec']};{t['rate']:.0f}Hz;{t['channels']}ch;{t['bits']}bit;packets={len(found.packets)};laced={laced};cues={len(found.cues)};last_ms={last};ms={found.duration:.3f};mean={mean:.4f};std={spread:.4f}"


def payload_of(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (64 if not text else 0))


PACKETS = "track long, timestamp_ns long, offset long, size long, keyframe boolean, lacing int, duration_ns long"


def to_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): each text as a Matroska file. Null text: empty. Null ids are kept."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), utf8(text_col).alias("b")).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row per packet: id, track, timestamp_ns, offset, size, keyframe, lacing, duration_ns (null if the file doesn't tell), in file order. Files without packets give no rows. An id column of one of these names comes out as kept_<name>."""
    bounded_batches(df.sparkSession)
    names = [apart(id_col, [p.split()[0] for p in PACKETS.split(", ")]), *(p.split()[0] for p in PACKETS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, m in enumerate(b.column(1).to_pylist()):
                found = parse(m).packets
                ids += [i] * len(found)
                rows += found
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.coalesce(F.col(media_col), F.lit(b"")).alias("m")).mapInArrow(run, f"`{names[0]}` {kind}, {PACKETS}")


def media_digest(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", n_col: str = "n_bytes") -> DataFrame:
    """Per media row: what its packets hold, digested. The payload is read back through the byte ranges that ``parse`` gives, which are those of ``packet_table``."""
    bounded_batches(df.sparkSession)
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                found = parse(m)
                payload = b"".join(m[at : at + n] for _, _, at, n, *_ in found.packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(m, found)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(n_col).cast("long").alias("n"), F.coalesce(F.col(media_col), F.lit(b"")).alias("m")).mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
