"""Matroska columns: packet tables from EBML bytes, and a lossless store for payloads.

:func:`parse` reads variable-length EBML elements (segments and clusters of
unknown size included), tracks, clusters, simple blocks and block groups with
no, Xiph, fixed-size or EBML lacing, and cues. Every frame becomes a packet
with its track, timestamp, flags and byte range in the file, so a payload can
be fetched by range without decoding anything else.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.tables import fresh

# Element identifiers of the public Matroska specification (fixed values)
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE, CUE_PLACE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7
TIME_SCALE, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, DURATION, REFERENCE = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
DOC_TYPE, SEEK, TAGS, CHAPTERS, ATTACHMENTS = 0x4282, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
TOP_LEVEL = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK, TAGS, CHAPTERS, ATTACHMENTS}

SAMPLE_RATE = 8000
FRAME = 512  # samples, 64 ms
LACED = 8  # frames of a block
BLOCKS = 32  # of a cluster


def _vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError(f"the file ends within an integer at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep_marker else value & ~(1 << 7 * n)), at + n


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """Identifier, start of the content and its end, which is None where the size is unknown."""
    begin = at
    ident, at = _vint(data, at, end, True)
    n = 9 - data[at].bit_length() if at < end and data[at] else 0
    size, at = _vint(data, at, end, False)
    if size == (1 << 7 * n) - 1:
        return ident, at, None
    if at + size > end:
        raise ValueError(f"element {ident:X} at byte {begin} runs past its parent's end")
    return ident, at, at + size


def _elements(data: bytes, at: int, end: int):
    """Identifier, start of the element, start and end of its content.

    A segment of unknown size ends with its parent, and a cluster of unknown
    size where the next element of its parent's level starts.
    """
    while at < end:
        begin = at
        ident, at, stop = _header(data, at, end)
        if stop is None:
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {ident:X} at byte {begin} has no size")
            stop = end if ident == SEGMENT else at
            while ident == CLUSTER and stop < end:
                other, _, last = _header(data, stop, end)
                if other in TOP_LEVEL:
                    break
                if last is None:
                    raise ValueError(f"element {other:X} at byte {stop} has no size")
                stop = last
        yield ident, begin, at, stop
        at = stop


def _whole(value: int, bits: int, what: str) -> int:
    if not -(1 << bits) <= value < 1 << bits:
        raise ValueError(f"{what} is out of range")
    return value


def _uint(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise ValueError(f"an integer of {b - a} bytes at byte {a}")
    return _whole(int.from_bytes(data[a:b], "big"), 63, f"the integer at byte {a}")


def _encodings(data: bytes, a: int, b: int) -> str:
    """What was done to a track's frames: their byte ranges hold the result, not the frames themselves."""
    out = []
    for i, _, p, q in _elements(data, a, b):
        if i == ENCODING:
            own = {k: (m, n) for k, _, m, n in _elements(data, p, q)}
            if ENCRYPTION in own:
                out.append("encryption")
            if COMPRESSION in own:
                inner = {k: (m, n) for k, _, m, n in _elements(data, *own[COMPRESSION])}
                kind = _uint(data, *inner[ALGORITHM]) if ALGORITHM in inner else 0
                out.append(("zlib", "bzlib", "lzo1x", "header")[kind] if kind < 4 else f"compression {kind}")
                if kind == 3 and SETTINGS in inner:
                    out[-1] += " " + data[slice(*inner[SETTINGS])].hex()
    return ", ".join(out)


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if lacing == 0:
        return [(at, end)]
    if at >= end:
        raise ValueError("a laced block without its frame count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed-size lacing over frames of unequal size")
        sizes = [(end - at) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError("the block ends within its lacing")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            width = 9 - data[at].bit_length() if at < end and data[at] else 0
            value, at = _vint(data, at, end, False)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        if s < 0 or at + s > end:
            raise ValueError("lacing runs past its block")
        out.append((at, at + s))
        at += s
    return out


def parse(data: bytes) -> dict:
    """``tracks``, ``packets`` and ``cues`` of a file; ValueError if it is damaged, and for numbers beyond the tables' types.

    A track's ``encoding`` says whether its frames are compressed, lack a common
    header (given in hexadecimal digits) or are encrypted. A cue point has a cue for each of its track positions.

    Laced frames follow each other by their track's default duration, or, where
    it has none, share the duration of their block group.
    """
    scale, tracks, packets, cues, clusters = 1_000_000, {}, [], [], 0
    top = list(_elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, _, a, b in top:
        if ident != SEGMENT:
            continue
        base = a
        # what clusters depend on may stand behind them
        for part, _, x, y in sorted(_elements(data, a, b), key=lambda e: e[0] not in (INFO, TRACKS)):
            if part == INFO:
                for i, _, p, q in _elements(data, x, y):
                    if i == TIME_SCALE:
                        scale = _uint(data, p, q)
            elif part == TRACKS:
                for i, _, p, q in _elements(data, x, y):
                    if i == TRACK:
                        own = {k: (m, n) for k, _, m, n in _elements(data, p, q)}
                        number = _whole(_uint(data, *own[TRACK_NUMBER]) if TRACK_NUMBER in own else 0, 31, "a track number")
                        tracks[number] = {
                            "track": number,
                            "kind": _whole(_uint(data, *own[TRACK_TYPE]) if TRACK_TYPE in own else 0, 31, "a track type"),
                            "codec": data[slice(*own[CODEC])].decode("ascii", "replace") if CODEC in own else "",
                            "frame_ns": _uint(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0,
                            "encoding": _encodings(data, *own[ENCODINGS]) if ENCODINGS in own else "",
                        }
            elif part == CLUSTER:
                time, cluster = 0, clusters
                clusters += 1
                for i, _, p, q in _elements(data, x, y):
                    if i == CLUSTER_TIME:
                        time = _uint(data, p, q)
                    elif i in (SIMPLE_BLOCK, BLOCK_GROUP):
                        group = [] if i == SIMPLE_BLOCK else list(_elements(data, p, q))
                        key = None if i == SIMPLE_BLOCK else all(k != REFERENCE for k, *_ in group)
                        lasts = next((_uint(data, m, n) * scale for k, _, m, n in group if k == DURATION), 0)
                        for m, n in [(p, q)] if i == SIMPLE_BLOCK else [(m, n) for k, _, m, n in group if k == BLOCK]:
                            number, at = _vint(data, m, n, False)
                            _whole(number, 31, "a track number")
                            if at + 3 > n:
                                raise ValueError("a block shorter than its header")
                            (relative,), flags = struct.unpack(">h", data[at : at + 2]), data[at + 2]
                            frames = _frames(data, at + 3, n, flags >> 1 & 3)
                            frame_ns = tracks.get(number, {}).get("frame_ns", 0) or lasts // len(frames)
                            for j, (c, d) in enumerate(frames):
                                packets.append((number, _whole((time + relative) * scale + j * frame_ns, 63, "a timestamp"), c, d - c, bool(flags & 128) if key is None else key, cluster, flags >> 1 & 3))
            elif part == CUES:
                for i, _, p, q in _elements(data, x, y):
                    if i == CUE:
                        own = list(_elements(data, p, q))
                        at_ns = next((_whole(_uint(data, m, n) * scale, 63, "a cue's time") for k, _, m, n in own if k == CUE_TIME), 0)
                        for place in ({k: _uint(data, m, n) for k, _, m, n in _elements(data, *at) if k in (CUE_TRACK, CUE_CLUSTER)} for k, _, *at in own if k == CUE_PLACE):
                            cues.append((at_ns, _whole(place.get(CUE_TRACK, 0), 31, "a track number"), _whole(base + place.get(CUE_CLUSTER, 0), 63, "a cue's place")))
    return {"tracks": list(tracks.values()), "packets": packets, "cues": cues, "clusters": clusters}


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, *content: bytes) -> bytes:
    body = b"".join(content)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == 3:
        sizes = [len(f) for f in frames]
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while abs(b - a) > (1 << 7 * width - 1) - 1:
                width += 1
            head += ((b - a + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


_HEAD = _element(EBML, _number(0x4286, 1), _number(0x42F7, 1), _number(0x42F2, 4), _number(0x42F3, 8), _element(DOC_TYPE, b"matroska"), _number(0x4287, 4), _number(0x4285, 2))
_INFO = _element(INFO, _number(TIME_SCALE, 1_000_000), _element(0x4D80, b"fieldloom"), _element(0x5741, b"fieldloom"))
_TRACKS = _element(
    TRACKS,
    _element(
        TRACK, _number(TRACK_NUMBER, 1), _number(TRACK_UID, 1), _number(TRACK_TYPE, 2), _number(LACING, 1), _element(CODEC, b"A_PCM/INT/LIT"), _number(DEFAULT_DURATION, FRAME * 10**9 // SAMPLE_RATE),
        _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)), _number(CHANNELS, 1), _number(BIT_DEPTH, 8)),
    ),
)


def store(payload: bytes) -> bytes:
    """A Matroska file with the payload as one track of 8-bit PCM samples.

    Blocks of equal frames use fixed-size lacing; the last block, whose last
    frame may be shorter, uses EBML and Xiph lacing by turns.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    parts, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    step, frame_ms = LACED * BLOCKS, FRAME * 1000 // SAMPLE_RATE
    for i in range(0, len(frames), step):
        time, blocks = i * frame_ms, []
        for j in range(i, min(i + step, len(frames)), LACED):
            group = frames[j : min(j + LACED, i + step)]
            lacing = 0 if len(group) == 1 else 2 if len(group[-1]) == len(group[0]) else 1 + 2 * (len(frames) % 2)
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", j * frame_ms - time, 128 | lacing << 1), _laced(group, lacing)))
        parts.append(_element(CLUSTER, _number(CLUSTER_TIME, time), *blocks))
        cues.append(_element(CUE, _number(CUE_TIME, time), _element(CUE_PLACE, _number(CUE_TRACK, 1), _number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return _HEAD + _element(SEGMENT, *parts, _element(CUES, *cues))


PACKETS = "array<struct<track:int,timestamp_ns:bigint,offset:bigint,size:bigint,key:boolean,cluster:int,lacing:int>>"
TABLE = f"struct<tracks:array<struct<track:int,kind:int,codec:string,frame_ns:bigint,encoding:string>>,packets:{PACKETS},cues:array<struct<timestamp_ns:bigint,track:int,cluster_offset:bigint>>,clusters:int,error:string>"
_PACKET = ("track", "timestamp_ns", "offset", "size", "key", "cluster", "lacing")
_CUE = ("timestamp_ns", "track", "cluster_offset")


def packet_tables(files: DataFrame, content_col: str, name: str = "media") -> DataFrame:
    """``files`` plus a struct of tracks, packets, cues, the number of clusters, and ``error``.

    Null content gives null; damaged content an error and no packets. Explode
    ``media.packets`` for a table of one row per packet.
    """

    @F.arrow_udf(TABLE)
    def read(contents: pa.Array) -> pa.Array:
        out = []
        for c in contents:
            data = c.as_py()
            if data is None:
                out.append(None)
                continue
            try:
                x = parse(data) | {"error": None}
            except ValueError as e:
                x = {"tracks": [], "packets": [], "cues": [], "clusters": 0, "error": str(e)}
            x["packets"] = [dict(zip(_PACKET, p, strict=True)) for p in x["packets"]]
            x["cues"] = [dict(zip(_CUE, p, strict=True)) for p in x["cues"]]
            out.append(x)
        return pa.array(out, ARROW_TABLE)

    return files.withColumn(fresh(files, name), read(F.col(content_col)))


ARROW_TABLE = pa.struct(
    [
        ("tracks", pa.list_(pa.struct([("track", pa.int32()), ("kind", pa.int32()), ("codec", pa.string()), ("frame_ns", pa.int64()), ("encoding", pa.string())]))),
        ("packets", pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("key", pa.bool_()), ("cluster", pa.int32()), ("lacing", pa.int32())]))),
        ("cues", pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int32()), ("cluster_offset", pa.int64())]))),
        ("clusters", pa.int32()),
        ("error", pa.string()),
    ]
)


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def feature(read: dict, payload: bytes) -> str:
    """Packets, clusters, cues and milliseconds, then the mean sample and the share of each sixteenth of its range."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 4, minlength=16) * 1000 // max(1, len(samples))
    ms = len(samples) * 1000 // SAMPLE_RATE
    return f"{len(read['packets'])}p {read['clusters']}c {len(read['cues'])}q {ms}ms {samples.mean():.3f} " + "-".join(map(str, shares))


def stored_payloads(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``stored`` (underscores added while the name is taken): each text's payload stored as Matroska and read back by its packets.

    The payload is the UTF-8 text (null: empty) and zero bytes up to a positive
    multiple of 64. The struct holds ``n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature``, of what was read back
    where it speaks of the payload. Equal texts have equal values.
    """

    @F.arrow_udf("struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
    def roundtrip(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            media = store(padded(text))
            read = parse(media)
            payload = b"".join(media[o : o + n] for _, _, o, n, _, _, _ in read["packets"])
            out.append(
                {
                    "n_bytes": len((text or "").encode("utf-8", "replace")),
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-64:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "feature": feature(read, payload),
                }
            )
        return pa.array(out, ARROW_STORED)

    return docs.withColumn(fresh(docs, "stored"), roundtrip(F.col(text_col)))


ARROW_STORED = pa.struct(
    [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def media_files(docs: DataFrame, text_col: str = "text", name: str = "content") -> DataFrame:
    """``docs`` plus the stored file's bytes, to be written or given to :func:`packet_tables`."""

    @F.arrow_udf("binary")
    def write(texts: pa.Array) -> pa.Array:
        return pa.array([store(padded(t.as_py())) for t in texts], pa.binary())

    return docs.withColumn(fresh(docs, name), write(F.col(text_col)))
