"""Reading and writing Matroska: variable-length EBML elements, clusters, lacing and cues.

``packets`` lists every frame of every track with its time stamp, place and length; the writer
stores a payload as 8-bit PCM samples.  Only what a media column needs is here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

# Element identifiers of the container format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
# Elements that hold elements, and those that end a cluster or segment of unknown size.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
SEGMENT_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
TOP_LEVEL = {EBML, SEGMENT}
LACES = ("none", "xiph", "fixed", "ebml")

SAMPLE_RATE = 8000
FRAME = 512
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16
SCALE = 1_000_000


class Malformed(ValueError):
    """The bytes are not a container of this format."""


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """``(value, next position)`` of a length; the value is None where all its bits are set (unknown)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no length at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"length cut off at {at}")
    bits = 7 * width
    value = int.from_bytes(data[at : at + width], "big") & ((1 << bits) - 1)
    return (None if value == (1 << bits) - 1 else value), at + width


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An identifier keeps its length marker."""
    if at >= len(data) or data[at] < 0x10:
        raise Malformed(f"no identifier at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"identifier cut off at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def write_size(value: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(name: int, value: float) -> bytes:
    return element(name, struct.pack(">d", value))


@dataclass(frozen=True, slots=True)
class Element:
    """An element with the range of its body; ``depth`` 0 is the top level."""

    name: int
    start: int
    end: int
    depth: int
    at: int


def elements(data: bytes) -> Iterator[Element]:
    """All elements in order, masters before what they hold.

    Where the data is torn off, masters end with it and an element that is not whole is left out.
    """
    at, ends = 0, []  # ends: (end of an open master, or None if unknown; its identifier)
    while at < len(data):
        while ends and ends[-1][0] is not None and at >= ends[-1][0]:
            ends.pop()
        begin = at
        try:
            name, at = read_id(data, at)
            size, at = read_size(data, at)
        except Malformed:
            if begin == 0:
                raise
            return  # a torn tail
        while ends and ends[-1][0] is None and (
            name in TOP_LEVEL or (ends[-1][1] == CLUSTER and name in SEGMENT_LEVEL)
        ):
            ends.pop()
        limit = next((e for e, _ in reversed(ends) if e is not None), len(data))
        if size is None and name not in (SEGMENT, CLUSTER):
            raise Malformed(f"unknown size of element {name:x}")
        if size is not None and at + size > len(data) and name not in MASTERS:
            return
        end = min(limit, at + size) if size is not None else limit
        yield Element(name, at, end, len(ends), begin)
        if name in MASTERS:
            ends.append((end if size is not None else None, name))
        else:
            at = end


def _unsigned(data: bytes, e: Element) -> int:
    return int.from_bytes(data[e.start : e.end], "big")


def _float(data: bytes, e: Element) -> float:
    return struct.unpack(">d" if e.end - e.start == 8 else ">f", data[e.start : e.end])[0] if e.end > e.start else 0.0


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first frame starts."""
    if lacing == 0:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise Malformed("fixed lacing does not divide the block")
        return [(end - at) // count] * count, at
    sizes = []
    if lacing == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
            sizes.append(size)
    else:
        for k in range(count - 1):
            start = at
            value, at = read_size(data, at)
            bits = 7 * (at - start)
            value = (1 << bits) - 1 if value is None else value
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << (bits - 1)) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("laced frames exceed the block")
    return sizes, at


@dataclass(slots=True)
class Packet:
    track: int
    cluster: int
    block: int
    frame: int
    timestamp_ns: int
    duration_ns: int | None
    keyframe: bool
    lacing: str
    start: int
    length: int


@dataclass(slots=True)
class Container:
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # (time stamp in ns, track, byte position of the cluster)
    clusters: list[int]
    duration_ns: float


def parse(data: bytes) -> Container:
    """Tracks, packets and cues of one container; ``Malformed`` if it is none."""
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    clusters: list[int] = []
    scale, duration, segment, base, blocks = SCALE, 0.0, 0, 0, 0
    track: dict = {}
    cue = [0, 0]
    group: list[Packet] = []
    seen = False
    for e in elements(data):
        name = e.name
        if not seen and name != EBML:
            raise Malformed("no header")
        seen = True
        if name in (SIMPLE_BLOCK, BLOCK):
            if e.end - e.start < 4:
                continue
            of, at = read_size(data, e.start)
            relative = int.from_bytes(data[at : at + 2], "big", signed=True)
            flags = data[at + 2]
            lacing = flags >> 1 & 3
            sizes, at = lace_sizes(data, at + 3, e.end, lacing)
            each = tracks.get(of, {}).get("default_duration")
            group = []
            for k, size in enumerate(sizes):
                group.append(
                    Packet(
                        of, len(clusters) - 1, blocks, k, (base + relative) * scale + k * (each or 0), each,
                        bool(flags & 0x80) if name == SIMPLE_BLOCK else True, LACES[lacing], at, size,
                    )
                )
                at += size
            packets += group
            blocks += 1
        elif name == CLUSTER:
            clusters.append(e.at)
        elif name == CLUSTER_TIME:
            base = _unsigned(data, e)
        elif name == BLOCK_DURATION:
            for p in group:
                p.duration_ns = _unsigned(data, e) * scale // len(group)
        elif name == REFERENCE:
            for p in group:
                p.keyframe = False
        elif name == SEGMENT:
            segment = e.start
        elif name == TIMESTAMP_SCALE:
            scale = _unsigned(data, e) or SCALE
        elif name == DURATION:
            duration = _float(data, e)
        elif name == TRACK_ENTRY:
            track = {}
        elif name == TRACK_NUMBER:
            tracks[_unsigned(data, e)] = track
        elif name == TRACK_TYPE:
            track["kind"] = _unsigned(data, e)
        elif name == CODEC:
            track["codec"] = data[e.start : e.end].rstrip(b"\0").decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            track["default_duration"] = _unsigned(data, e)
        elif name == RATE:
            track["rate"] = _float(data, e)
        elif name == CHANNELS:
            track["channels"] = _unsigned(data, e)
        elif name == BIT_DEPTH:
            track["bits"] = _unsigned(data, e)
        elif name == CUE_TIME:
            cue[0] = _unsigned(data, e)
        elif name == CUE_TRACK:
            cue[1] = _unsigned(data, e)
        elif name == CUE_CLUSTER:
            cues.append((cue[0] * scale, cue[1], segment + _unsigned(data, e)))
    if not seen:
        raise Malformed("empty")
    return Container(tracks, packets, cues, clusters, duration * scale)


def payload(data: bytes, found: Container, track: int = 1) -> bytes:
    """The bytes of a track's frames in order."""
    return b"".join([data[p.start : p.start + p.length] for p in found.packets if p.track == track])


def _block(frames: list[bytes], relative: int, lacing: str) -> bytes:
    head = write_size(1) + struct.pack(">hB", relative, 0x80 | LACES.index(lacing) << 1)
    if lacing == "none":
        return element(SIMPLE_BLOCK, head + frames[0])
    sizes, lace = [len(f) for f in frames], bytes([len(frames) - 1])
    if lacing == "xiph":
        lace += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        lace += write_size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
            lace += write_size(b - a + (1 << (7 * width - 1)) - 1, width)
    return element(SIMPLE_BLOCK, head + lace + b"".join(frames))


def write_samples(samples: bytes, rate: int = SAMPLE_RATE, frame: int = FRAME, lacing: str | None = None) -> bytes:
    """A container with one track of unsigned 8-bit samples.

    Blocks of equal frames use fixed lacing, a last block with a short frame EBML lacing, and
    single frames none; ``lacing`` asks for one kind instead.
    """
    head = element(
        EBML,
        number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2),
    )
    info = element(
        INFO,
        number(TIMESTAMP_SCALE, SCALE) + real(DURATION, len(samples) * 1000 / rate)
        + element(MUXING_APP, b"casegraph") + element(WRITING_APP, b"casegraph"),
    )
    audio = element(AUDIO, real(RATE, float(rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(
        TRACKS,
        element(
            TRACK_ENTRY,
            number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING, 1)
            + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * 10**9 // rate) + audio,
        ),
    )
    parts, at, points = [info, tracks], len(info) + len(tracks), []
    per_block = frame * FRAMES_PER_BLOCK
    for start in range(0, len(samples), per_block * BLOCKS_PER_CLUSTER):
        time = start * 1000 // rate
        body = [number(CLUSTER_TIME, time)]
        for b in range(start, min(len(samples), start + per_block * BLOCKS_PER_CLUSTER), per_block):
            chunk = samples[b : min(len(samples), b + per_block)]
            frames = [chunk[i : i + frame] for i in range(0, len(chunk), frame)]
            kind = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == frame else "ebml"
            if lacing and len(frames) > 1 and (lacing != "fixed" or kind == "fixed"):
                kind = lacing
            if kind == "none" and len(frames) > 1:
                body += [_block([f], (b + k * frame) * 1000 // rate - time, kind) for k, f in enumerate(frames)]
            else:
                body.append(_block(frames, b * 1000 // rate - time, kind))
        points.append((time, at))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    cues = b"".join(
        element(
            CUE_POINT,
            number(CUE_TIME, t) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, p)),
        )
        for t, p in points
    )
    parts.append(element(CUES, cues))
    return head + element(SEGMENT, b"".join(parts))
