"""Media columns: Matroska files as binary columns, and their packet tables.

The reader walks variable-length EBML elements: sizes known or unknown, clusters, simple blocks and
block groups, all four kinds of lacing, and cues. The writer stores 8-bit PCM audio in FRAME-byte packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FRAME, LACE, BLOCKS, RATE = 192, 8, 32, 8000

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOCTYPE, DOCTYPE_VERSION, SCALE, ENTRY, NUMBER, UID, KIND, CODEC, DURATION = 0x4282, 0x4287, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1


def size_bytes(n: int, width: int = 0) -> bytes:
    """A length as a variable-length integer; the all-ones value is reserved for unknown."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(i: int, body: bytes) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], kind: int) -> bytes:
    """Frames of a block after its flags: kind 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == 3:
        head += size_bytes(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            w = next(w for w in range(1, 9) if abs(len(b) - len(a)) < (1 << 7 * w - 1) - 1)
            head += size_bytes(len(b) - len(a) + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit PCM track that holds the payload, a multiple of FRAME bytes."""
    ms = FRAME * 1000 // RATE
    head = element(EBML, element(DOCTYPE, b"matroska") + number(DOCTYPE_VERSION, 4))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    track = element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(DURATION, ms * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    body = bytearray(element(INFO, number(SCALE, 1_000_000)) + element(TRACKS, track))
    cues, frames = b"", [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    for c in range(0, len(frames), LACE * BLOCKS):
        cues += element(POINT, number(CUE_TIME, c * ms) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, len(body))))
        blocks = [number(TIMESTAMP, c * ms)]
        for b in range(c, min(c + LACE * BLOCKS, len(frames)), LACE):
            group = frames[b : b + LACE]
            kind = 0 if len(group) == 1 else (2, 1, 3)[b // LACE % 3]
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (b - c) * ms, 0x80 | kind << 1) + _laced(group, kind)))
        body += element(CLUSTER, b"".join(blocks))
    return head + element(SEGMENT, bytes(body) + element(CUES, cues))


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, width and next position of a variable-length integer; keep: with its marker, as ids are."""
    first = data[at]
    if not first:
        raise ValueError("a length marker is missing")
    w = 9 - first.bit_length()
    if at + w > len(data):
        raise ValueError("an integer is cut off")
    raw = int.from_bytes(data[at : at + w], "big")
    return (raw if keep else raw ^ 1 << 7 * w), w, at + w


_MASTER = {SEGMENT, CLUSTER, CUES, POINT, POSITIONS, GROUP, INFO, TRACKS, ENTRY, AUDIO}
_WHOLE = {NUMBER: "number", KIND: "kind", DURATION: "duration", CHANNELS: "channels", DEPTH: "depth"}


def parse(data: bytes, unit: int = 1_000_000) -> tuple[list[tuple], list[tuple], int, list[dict]]:
    """Packets (track, timestamp in units of so many ns, byte offset, length, key frame), cues (time, track, byte offset of
    the cluster), the number of clusters, and tracks (number, kind, codec, rate, channels, depth, duration of
    a frame in ns). Frames of a lace follow each other by their track's frame duration; without one they
    share their block's timestamp. A block in a group is a key frame if the group refers to no other block. Raises ValueError on damaged structure."""
    packets, cues, tracks, clusters, scale, base, time, segment, cue = [], [], [], 0, 1_000_000, 0, 0, 0, {}
    lasts, group, refers = {}, 0, False
    at, end = 0, len(data)
    first, _, _ = _vint(data, 0, True) if data else (0, 0, 0)
    if first != EBML:
        raise ValueError("not an EBML file")
    while at < end:
        i, _, at = _vint(data, at, True)
        n, w, at = _vint(data, at)
        if n == (1 << 7 * w) - 1:
            n = end - at  # unknown: up to the next element of a higher level, which the walk meets itself
        if at + n > end:
            raise ValueError("an element is cut off")
        if i == SEGMENT:
            segment = at
        elif i == CLUSTER:
            clusters += 1
        elif i == ENTRY:
            tracks.append({})
        elif i == GROUP:
            group, refers = len(packets), False
        elif i == REFERENCE:  # before or behind the group's block
            refers = True
            packets[group:] = [(*p[:4], False) for p in packets[group:]]
        if i in _MASTER:
            continue
        if i in (SIMPLE, BLOCK):
            stop = at + n
            track, _, p = _vint(data, at)
            shift, flags = struct.unpack_from(">hB", data, p)
            time, p, kind = base + shift, p + 3, flags >> 1 & 3
            count = data[p] + 1 if kind else 1
            p += bool(kind)
            sizes = []
            if kind == 1:
                for _ in range(count - 1):
                    s = 0
                    while data[p] == 255:
                        s, p = s + 255, p + 1
                    sizes.append(s + data[p])
                    p += 1
            elif kind == 3 and count > 1:
                s, _, p = _vint(data, p)
                sizes.append(s)
                for _ in range(count - 2):
                    d, w, p = _vint(data, p)
                    sizes.append(sizes[-1] + d - (1 << 7 * w - 1) + 1)
            if kind == 2:
                sizes = [(stop - p) // count] * count
            else:
                sizes.append(stop - p - sum(sizes))
            if min(sizes) < 0 or p + sum(sizes) != stop:
                raise ValueError("a lace does not fill its block")
            lasts = lasts or {t.get("number"): t.get("duration", 0) for t in tracks}
            for k, s in enumerate(sizes):
                packets.append((track, (time * scale + k * lasts.get(track, 0)) // unit, p, s, bool(flags & 0x80) if i == SIMPLE else not refers))
                p += s
        elif tracks and i in _WHOLE:
            tracks[-1][_WHOLE[i]] = int.from_bytes(data[at : at + n], "big")
        elif tracks and i == CODEC:
            tracks[-1]["codec"] = data[at : at + n].decode("ascii", "replace")
        elif tracks and i == SAMPLING:
            tracks[-1]["rate"] = struct.unpack(">d" if n == 8 else ">f", data[at : at + n])[0]
        elif i == TIMESTAMP:
            base = int.from_bytes(data[at : at + n], "big")
        elif i == SCALE:
            scale = int.from_bytes(data[at : at + n], "big")
        elif i in (CUE_TIME, CUE_TRACK):
            cue[i] = int.from_bytes(data[at : at + n], "big")
        elif i == CUE_CLUSTER:
            cues.append((cue.get(CUE_TIME, 0) * scale // unit, cue.get(CUE_TRACK, 0), segment + int.from_bytes(data[at : at + n], "big")))
        at += n
    return packets, cues, clusters, tracks


PACKETS = "doc_id long, track int, timestamp_ms long, byte_offset long, length int, keyframe boolean"


TRACK_FIELDS = "doc_id long, track int, kind int, codec string, rate double, channels int, depth int, frame_ns long"


def _table(media: DataFrame, schema: str, rows_of: Callable[[bytes], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, m in zip(f["doc_id"].array, f["media"], strict=True):
                try:
                    found = rows_of(m) if m else []
                except (ValueError, IndexError, struct.error):
                    found = []
                if found:
                    out = pd.DataFrame(found, columns=names[1:])
                    out.insert(0, "doc_id", pd.array([None if pd.isna(i) else i] * len(out), dtype="Int64"))
                    yield out

    return media.select("doc_id", "media").mapInPandas(rows, schema)


def packet_table(media: DataFrame) -> DataFrame:
    """A row a packet of each media column (doc_id, media binary). Null, empty or damaged media give none,
    repeated rows repeat their packets, an empty table gives no rows; other columns are not read."""
    return _table(media, PACKETS, lambda m: parse(m)[0])


PACKET_DIGESTS = "doc_id long, packet int, track int, timestamp_ns long, byte_offset long, length int, keyframe boolean, packet_sha256 string"


def packet_digests(media: DataFrame) -> DataFrame:
    """The packet table with places, exact timestamps and the digest of each packet's bytes; the same rules."""

    def rows_of(m: bytes) -> list[tuple]:
        return [(k, *p, hashlib.sha256(m[p[2] : p[2] + p[3]]).hexdigest()) for k, p in enumerate(parse(m, 1)[0])]

    return _table(media, PACKET_DIGESTS, rows_of)


def damaged(media: DataFrame) -> DataFrame:
    """(doc_id, error) of media that cannot be parsed and so have no rows in the tables; null and empty ones are not damaged."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, m in zip(f["doc_id"].array, f["media"], strict=True):
                try:
                    if m:
                        parse(m)
                except (ValueError, IndexError, struct.error) as e:
                    out.append((None if pd.isna(i) else i, str(e)))
            bad = pd.DataFrame(out, columns=["doc_id", "error"])
            bad["doc_id"] = bad["doc_id"].astype("Int64")
            yield bad

    return media.select("doc_id", "media").mapInPandas(rows, "doc_id long, error string")


def track_table(media: DataFrame) -> DataFrame:
    """A row a track of each media column, with the same rules."""
    return _table(media, TRACK_FIELDS, lambda m: [tuple(t.get(k) for k in ("number", "kind", "codec", "rate", "channels", "depth", "duration")) for t in parse(m)[3]])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, padded with spaces to a positive multiple of FRAME."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = [(t or "").encode() for t in f["text"]]
            n = [len(r) for r in raw]
            media = [write(r.ljust(max(1, -(-len(r) // FRAME)) * FRAME)) for r in raw]
            yield pd.DataFrame({"doc_id": f["doc_id"].array, "n_bytes": n, "media": media})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of media columns (doc_id, n_bytes, media), from the packets' bytes alone.

    feature: codec, counts of packets, clusters and cues that point at a cluster, the end of the last packet
    in ms, and mean and peak of the samples. Null and empty texts are one packet of spaces; repeated rows and null ids are
    kept; an empty table gives no rows.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, n, m in zip(f["doc_id"].array, f["n_bytes"], f["media"], strict=True):
                packets, cues, clusters, tracks = parse(m)
                payload = b"".join([m[at : at + size] for _, _, at, size, _ in packets])
                samples = np.frombuffer(payload, dtype=np.uint8)
                good = sum(m[at : at + 4] == CLUSTER.to_bytes(4, "big") for _, _, at in cues)
                last = tracks[0]["duration"] // 1_000_000
                feature = f"codec={tracks[0]['codec']};packets={len(packets)};clusters={clusters};cues={good};end_ms={packets[-1][1] + last};mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};peak={int(samples.max())}"
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return media.mapInPandas(rows, DIGEST)
