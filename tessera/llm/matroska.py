"""Matroska: EBML elements, clusters, lacing and cues as packet tables with timestamps, tracks and byte ranges."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the public EBML and Matroska specifications (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end an unknown-sized cluster or segment.
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}
LACING = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}

#: The stored form: 8 kHz mono 8-bit PCM, so that 192 samples last 24 ms; frames in a block, blocks in a cluster.
RATE, FRAME, FRAMES, BLOCKS = 8000, 192, 8, 64


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length integer of EBML, in the fewest bytes that hold it."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, marked: bool = False) -> tuple[int, int]:
    """Value (with its marker bit if asked, -1 for the unknown size) and the position after it."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no EBML number at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if marked:
        return raw, at + width
    value = raw ^ 1 << 7 * width
    return -1 if value == (1 << 7 * width) - 1 else value, at + width


def element(kind: int, content: bytes | int | float | str) -> bytes:
    if isinstance(content, float):
        import struct

        content = struct.pack(">d", content)
    elif isinstance(content, int):
        content = content.to_bytes(max(1, (content.bit_length() + 7) // 8), "big")
    elif isinstance(content, str):
        content = content.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def lace(frames: list[bytes], lacing: str) -> bytes:
    """Lace head and frames of a block."""
    head = b"" if lacing == "none" else bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0])
        for before, n in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = 1
            while not -(1 << 7 * width - 1) < n - before < (1 << 7 * width - 1):
                width += 1
            head += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Offset and size of each frame of a block whose flags stand just before `at`."""
    if not lacing:
        return [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("a fixed-size lace doesn't divide evenly")
        sizes = [(end - at) // count] * count
    elif lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for k in range(count - 1):
            begin = at
            value, at = read_vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1))
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("a lace is larger than its block")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


_HEAD = element(EBML, b"".join(element(k, v) for k, v in ((EBML_VERSION, 1), (EBML_READ_VERSION, 1), (EBML_MAX_ID, 4), (EBML_MAX_SIZE, 8), (DOC_TYPE, "matroska"), (DOC_TYPE_VERSION, 4), (DOC_TYPE_READ_VERSION, 2))))


def write_pcm(payload: bytes, lacing: str = "fixed") -> bytes:
    """A Matroska file of one track of 8-bit samples: frames of FRAME bytes, laced into blocks, with cues."""
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, "tessera") + element(WRITING_APP, "tessera"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    entry = element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT") + audio
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    position = sum(map(len, body))
    block_bytes = FRAME * (FRAMES if lacing != "none" else 1)
    cues = []
    for begin in range(0, len(payload), block_bytes * BLOCKS):
        time = begin * 1000 // RATE
        blocks = [element(TIMESTAMP, time)]
        for at in range(begin, min(len(payload), begin + block_bytes * BLOCKS), block_bytes):
            frames = [payload[i : i + FRAME] for i in range(at, min(len(payload), at + block_bytes), FRAME)]
            kind = lacing if len(frames) > 1 else "none"
            head = b"\x81" + (at * 1000 // RATE - time).to_bytes(2, "big") + bytes([0x80 | LACING[kind] << 1])
            blocks.append(element(SIMPLE_BLOCK, head + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, position))))
        body.append(cluster)
        position += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds.  packets: (track, time in ms, byte offset, size, keyframe, cluster's offset)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, float, int, int, bool, int]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    cues: list[tuple[float, int, int]] = field(default_factory=list)
    clusters: int = 0


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file; laced frames share their block's time unless the track is PCM.

    Elements of unknown kind are skipped, clusters and segments may have the unknown size, and a file that is cut
    off gives the packets that are whole.  An element whose content makes no sense is skipped and noted in `errors`.
    A file without an EBML head raises ValueError.
    """
    found = Media()
    if data[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("not an EBML file")
    scale = 1_000_000
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    cluster, cluster_time, segment = 0, 0, 0
    track: dict = {}
    cue: dict = {}
    stack: list[tuple[int, int]] = []
    at = 0
    while at < len(data):
        while stack and at >= stack[-1][1]:
            stack.pop()
        begin = at
        try:
            kind, at = read_vint(data, at, marked=True)
            size, at = read_vint(data, at)
        except (ValueError, IndexError):
            break
        if kind in _TOP:
            while stack and stack[-1][0] == CLUSTER and kind != CLUSTER or stack and kind == CLUSTER and stack[-1][0] == CLUSTER:
                stack.pop()
        end = len(data) if size < 0 else at + size
        if kind in _MASTERS:
            stack.append((kind, min(end, len(data))))
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                found.clusters += 1
                cluster = begin
            elif kind == TRACK_ENTRY:
                track = {}
            elif kind == CUE_POINT:
                cue = {}
            continue
        if end > len(data):
            break
        try:
            if kind in (SIMPLE_BLOCK, BLOCK):
                n, head = read_vint(data, at)
                flags = data[head + 2]
                time = cluster_time + int.from_bytes(data[head : head + 2], "big", signed=True)
                entry = found.tracks.get(n, {})
                if head + 3 > end:
                    raise ValueError("a block without a head")
                rate = entry.get("rate") if str(entry.get("codec", "")).startswith("A_PCM") else None
                grain = max(1, entry.get("channels", 1)) * max(1, entry.get("bits", 8)) / 8 * (rate or 1) / 1000
                passed = 0
                for offset, length in unlace(data, head + 3, end, flags >> 1 & 3):
                    shift = passed / grain if rate else 0.0
                    found.packets.append((n, time * scale / 1e6 + shift, offset, length, bool(flags & 0x80) or kind == BLOCK, cluster))
                    passed += length
            elif kind == TIMESTAMP:
                cluster_time = number(at, end)
            elif kind == TIMESTAMP_SCALE:
                scale = number(at, end)
            elif kind == TRACK_NUMBER:
                found.tracks[number(at, end)] = track
            elif kind == TRACK_TYPE:
                track["type"] = number(at, end)
            elif kind == CODEC_ID:
                track["codec"] = data[at:end].decode("ascii", "replace")
            elif kind == SAMPLING_FREQUENCY:
                if end - at not in (4, 8):
                    raise ValueError("a number of neither four nor eight bytes")
                rate = float(np.frombuffer(data[at:end], f">f{end - at}")[0])
                track["rate"] = rate if 0 < rate < 1e9 else None
            elif kind in (CHANNELS, BIT_DEPTH):
                track["channels" if kind == CHANNELS else "bits"] = number(at, end)
            elif kind == CUE_TIME:
                cue["time"] = number(at, end) * scale / 1e6
            elif kind == CUE_TRACK:
                cue["track"] = number(at, end)
            elif kind == CUE_CLUSTER_POSITION:
                found.cues.append((cue.get("time", 0.0), cue.get("track", 0), segment + number(at, end)))
        except (ValueError, IndexError, OverflowError) as e:
            found.errors.append(f"element {kind:x} at byte {begin}: {e}")
        at = end
    return found


def packet_table(media: DataFrame, key: str = "doc_id", content: str = "media") -> DataFrame:
    """A row for each packet of each file: key, track, codec, time_ms, offset, size, keyframe, cluster, cued, error.

    A null content gives no rows.  A content that isn't EBML gives one row with nothing but key and error, and each
    damaged element of a file one as well; the file's other packets are read.  Columns other than the two are ignored.
    """
    kind = dict(media.dtypes)[key]
    names = ["key", "track", "codec", "time_ms", "offset", "size", "keyframe", "cluster", "cued", "error"]
    most = (1 << 63) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            for k, data in zip(batch["key"], batch["content"], strict=True):
                raw = data.as_py()
                if raw is None:
                    continue
                try:
                    found = parse(raw)
                except ValueError as e:
                    found = Media(errors=[str(e)])
                cued = {c[2] for c in found.cues}
                made = [(min(n, most), found.tracks.get(n, {}).get("codec"), time, offset, size, keyframe, cluster, cluster in cued, None) for n, time, offset, size, keyframe, cluster in found.packets]
                made += [(*[None] * 8, e) for e in found.errors]
                for i in range(0, len(made), 20_000):
                    some = made[i : i + 20_000]
                    columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(some), batch["key"].type), *columns], names=names)

    schema = f"key {kind}, track long, codec string, time_ms double, offset long, size long, keyframe boolean, cluster long, cued boolean, error string"
    return media.select(F.col(f"`{key}`").alias("key"), F.col(f"`{content}`").cast("binary").alias("content")).mapInArrow(rows, schema).withColumnRenamed("key", key)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = []
            for text in part["text"]:
                raw = (text.as_py() or "").encode()
                media = write_pcm(raw + b" " * (-len(raw) % FRAME if raw else FRAME))
                found = parse(media)
                payload = b"".join([media[o : o + n] for _, _, o, n, _, _ in found.packets])
                samples = np.frombuffer(payload, np.uint8)
                feature = {
                    "codec": found.tracks[1]["codec"], "packets": len(found.packets), "clusters": found.clusters, "cues": len(found.cues), "ms": len(payload) * 1000 // RATE,
                    "last_ms": int(found.packets[-1][1]), "mean": round(int(samples.sum(dtype=np.int64)) / len(samples), 4), "turns": int(np.count_nonzero((samples[1:] > 100) != (samples[:-1] > 100))),
                }
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature, separators=(",", ":")), media))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"])


def stored_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a Matroska file of 8-bit samples, and what reading the file back gives.

    docs has doc_id and text; other columns are ignored.  The payload is the text's UTF-8, followed by spaces up to a
    positive multiple of FRAME bytes; a null or empty text is all spaces.  Equal texts give equal values, repeated rows
    repeated results; no rows, no result rows.  `media` is the file itself.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, schema)
