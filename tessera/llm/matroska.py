"""Matroska media columns: variable-length EBML elements, clusters, lacing and cues parsed into packet tables.

`packets` turns a binary column of Matroska files into one row per frame with track, timestamp and byte range; `mux_pcm`
writes 8-bit PCM payloads as Matroska, so that texts can be stored as media and read back. Everything works file by file
inside a task: no shuffle, and a file's cost is linear in its bytes.
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

from tessera.llm.common import map_texts, text_or_empty

EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0x1549A966
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP, SCALE = 0xA3, 0xA0, 0xA1, 0xE7, 0x2AD7B1
TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0xAE, 0xD7, 0x83, 0x86, 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
RATE, FRAME, LACED, PER_CLUSTER = 8000, 768, 8, 32
UNIT = 192


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, all value bits set) of the variable-length integer at `at`."""
    first = data[at]
    if not first:
        raise ValueError(f"bad EBML integer at {at}")
    width = 9 - first.bit_length()
    end = at + width
    if end > len(data):
        raise ValueError(f"EBML integer cut off at {at}")
    raw = int.from_bytes(data[at:end], "big")
    mask = (1 << 7 * width) - 1
    return (raw if keep_marker else raw & mask), end, raw & mask == mask


def write_size(n: int) -> bytes:
    """The shortest size field for n; a field of ones alone is reserved."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of the elements in data[at:end]; one of unknown size ends before the next of its level or above."""
    while at < end:
        eid, body, _ = read_vint(data, at, keep_marker=True)
        size, body, unknown = read_vint(data, body)
        if unknown:
            stop = end
            if eid == CLUSTER:
                stop = body
                while stop < end:
                    child, start, _ = read_vint(data, stop, keep_marker=True)
                    if child in TOP:
                        break
                    size, start, _ = read_vint(data, start)
                    stop = start + size
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element {eid:x} at {at} runs past its parent")
        yield eid, body, stop
        at = stop


def lace_xiph(sizes: list[int]) -> bytes:
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])


def lace_ebml(sizes: list[int]) -> bytes:
    out = write_size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        d, width = b - a, 1
        while not -(1 << 7 * width - 1) < d < 1 << 7 * width - 1:
            width += 1
        out += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return out


def lace_sizes(data, at: int, end: int, mode: int) -> tuple[list[int], int]:
    """Frame sizes of a laced block whose lace header starts at `at`, and where the frames start."""
    count, at = data[at] + 1, at + 1
    if mode == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    while len(sizes) < count - 1:
        if mode == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            before = at
            n, at, _ = read_vint(data, at)
            if sizes:
                n = sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes run past the block")
    return sizes, at


@dataclass
class Movie:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: track, time in nanoseconds, position, size, cluster
    packets: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    segment: int = 0


def number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def read_block(movie: Movie, data, a: int, b: int, base: int) -> None:
    track, at, _ = read_vint(data, a)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    mode = flags >> 1 & 3
    sizes, at = lace_sizes(data, at, b, mode) if mode else ([b - at], at)
    step, t = movie.tracks.get(track, {}).get("duration", 0), (base + time) * movie.scale
    for n in sizes:
        movie.packets.append((track, t, at, n, len(movie.clusters) - 1))
        at, t = at + n, t + step


def parse(data) -> Movie:
    """Tracks, cues and packets of a Matroska file; ValueError where it is malformed."""
    movie = Movie()
    try:
        for eid, a, b in elements(data, 0, len(data)):
            if eid != SEGMENT:
                continue
            movie.segment = a
            for top, c, d in elements(data, a, b):
                if top == INFO:
                    for k, e, f in elements(data, c, d):
                        if k == SCALE:
                            movie.scale = number(data, e, f)
                elif top == TRACKS:
                    for _, e, f in elements(data, c, d):
                        t = {k: (g, h) for k, g, h in elements(data, e, f)}
                        if TRACK_NUMBER in t:
                            one = {"type": number(data, *t[TRACK_TYPE]) if TRACK_TYPE in t else 0, "codec": bytes(data[slice(*t[CODEC])]).decode() if CODEC in t else ""}
                            movie.tracks[number(data, *t[TRACK_NUMBER])] = one | {"duration": number(data, *t[DEFAULT_DURATION]) if DEFAULT_DURATION in t else 0}
                elif top == CUES:
                    for _, e, f in elements(data, c, d):
                        time, places = 0, []
                        for k, g, h in elements(data, e, f):
                            if k == CUE_TIME:
                                time = number(data, g, h)
                            elif k == CUE_POSITIONS:
                                places.append({x: number(data, y, z) for x, y, z in elements(data, g, h)})
                        movie.cues += [(p.get(CUE_TRACK, 0), time * movie.scale, movie.segment + p.get(CUE_CLUSTER, 0)) for p in places]
                elif top == CLUSTER:
                    base = 0
                    movie.clusters.append(c)
                    for k, e, f in elements(data, c, d):
                        if k == TIMESTAMP:
                            base = number(data, e, f)
                        elif k == SIMPLE_BLOCK:
                            read_block(movie, data, e, f, base)
                        elif k == BLOCK_GROUP:
                            for x, g, h in elements(data, e, f):
                                if x == BLOCK:
                                    read_block(movie, data, g, h, base)
    except (IndexError, struct.error) as e:
        raise ValueError(f"cut off: {e}") from e
    return movie


def _head(samples: int) -> bytes:
    audio = element(0xE1, element(0xB5, struct.pack(">d", RATE)) + uint(0x9F, 1) + uint(0x6264, 8))
    track = uint(TRACK_NUMBER, 1) + uint(0x73C5, 1) + uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + audio
    info = uint(SCALE, 1_000_000) + element(0x4489, struct.pack(">d", samples * 1000 / RATE)) + element(0x4D80, b"tessera") + element(0x5741, b"tessera")
    return element(INFO, info) + element(TRACKS, element(TRACK_ENTRY, track))


_EBML_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_WHOLE = [FRAME] * LACED
_LACES = {1: lace_xiph(_WHOLE), 2: b"", 3: lace_ebml(_WHOLE)}


def mux_pcm(payload: bytes) -> bytes:
    """A Matroska file with the payload's bytes as unsigned 8-bit mono samples; blocks use Xiph, fixed and EBML lacing in turn."""
    body = [_head(len(payload))]
    at, cues = len(body[0]), []
    span = FRAME * LACED
    for c in range(0, len(payload), span * PER_CLUSTER):
        start = c * 1000 // RATE
        parts = [uint(TIMESTAMP, start)]
        for n, b in enumerate(range(c, min(len(payload), c + span * PER_CLUSTER), span)):
            data = payload[b : b + span]
            mode = n % 3 + 1
            if len(data) == span:
                lace = bytes([LACED - 1]) + _LACES[mode]
            else:
                sizes = [min(FRAME, len(data) - i) for i in range(0, len(data), FRAME)]
                if len(sizes) == 1:
                    mode, lace = 0, b""
                else:
                    mode = 3 if mode == 2 and sizes[-1] != FRAME else mode
                    lace = bytes([len(sizes) - 1]) + (lace_xiph(sizes) if mode == 1 else lace_ebml(sizes) if mode == 3 else b"")
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - start, 0x80 | mode << 1) + lace + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _EBML_HEAD + element(SEGMENT, b"".join(body))


def samples_of(data: bytes, movie: Movie) -> bytes:
    view = memoryview(data)
    return b"".join([view[p : p + n] for _, _, p, n, _ in movie.packets])


def feature(payload: bytes, movie: Movie) -> str:
    """Integer features of the stored samples: packets, clusters, cues, duration in samples, sum, energy, crossings of the middle, peak."""
    s = np.frombuffer(payload, np.uint8)
    counts = np.bincount(s, minlength=256)
    values = np.arange(256, dtype=np.int64)
    high = s >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    last = max((t for _, t, _, _, _ in movie.packets), default=0)
    return f"packets={len(movie.packets)};clusters={len(movie.clusters)};cues={len(movie.cues)};last_ms={last // 10**6};sum={int(counts @ values)};energy={int(counts @ (values - 128) ** 2)};crossings={crossings};peak={int(values[counts > 0].max(initial=0))}"


def packets(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, track, codec, n, time_ns, position, size, cluster, indexed (the cluster has a cue), error.

    A null or empty file gives no rows; a malformed one gives one row with its error and nulls. Repeated rows are parsed
    each; null ids are kept; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "track", "codec", "n", "time_ns", "position", "size", "cluster", "indexed", "error"]

    def start():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not media:
                    continue
                try:
                    m = parse(media)
                    cued = {p for _, _, p in m.cues}
                    first = {k: any(c - 12 <= p < c for p in cued) for k, c in enumerate(m.clusters)}
                    rows += [(i, t, m.tracks.get(t, {}).get("codec"), n, time, at, size, c, first[c], None) for n, (t, time, at, size, c) in enumerate(m.packets)]
                except ValueError as e:
                    rows.append((i, *[None] * 8, str(e)))
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 10, types)], names=names)

        return step

    return map_texts(df.select(F.col(id_col), F.col(media_col)), start, f"id {kind}, track long, codec string, n long, time_ns long, position long, size long, cluster long, indexed boolean, error string")


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of 192 bytes, and the length without them."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as Matroska samples, read back and described; see the digest columns in the schema.

    Null and empty texts are 192 spaces. Every row gives one row, repeated or not; equal texts give equal values; other
    columns are ignored. A file that doesn't give its payload back is an error.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def start():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in b.column(1).to_pylist():
                payload, n = padded(text)
                media = mux_pcm(payload)
                movie = parse(media)
                back = samples_of(media, movie)
                if back != payload:
                    raise ValueError("the stored bytes differ from the payload")
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, movie)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), t) for x, t in zip(zip(*rows), types))], names=names)

        return step

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(docs.select(F.col(id_col), text_or_empty(text_col)), start, schema)
