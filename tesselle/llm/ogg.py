"""Ogg containers in binary columns: writing, page-level reading and a digest of media columns.

Reading verifies each page's checksum, joins lacing values to packets (also over page ends), keeps
logical streams apart by serial number and gives each packet a time from granule positions. A page
that fails its checksum is skipped and counted; a packet that it cut is dropped, later ones stand.

Null and empty texts are one frame of padding; null media have no streams. Rows are handled one by
one, so repeated rows and null ids give rows like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.storage import text_rows

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = 0xFFFFFFFFFFFFFFFF
#: Header packet of the 8-bit sample streams written here.
CODEC = b"\x80u8pcm\x00\x00"
FRAME = 576
RATE = 8000

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's checksum: polynomial 0x04C11DB7, most significant bit first, from zero.

    It equals the mirrored zlib checksum of the mirrored bytes, which runs in C.
    """
    x = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def lace(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[tuple[int, bytes]]:
    """(granule, page) of a logical stream: the header packet alone on the first page, then as many as fit.

    A page's granule is that of the last packet that ends on it, or none if no packet does.
    """
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, cont = bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, cont
        flags = CONTINUED * cont | FIRST * (not out) | LAST * last
        at = granule if granule != NO_GRANULE else (out[-1][0] if out else 0)
        out.append((at, page(serial, len(out), flags, granule, bytes(lacing), bytes(body))))
        lacing, body, granule, cont = bytearray(), bytearray(), NO_GRANULE, False

    for k, (p, g) in enumerate(zip(packets, granules)):
        values, at = lace(len(p)), 0
        while values:
            room = 255 - len(lacing)
            take, values = values[:room], values[room:]
            n = sum(take)
            lacing += take
            body += p[at : at + n]
            at += n
            if not values:
                granule = g
            if len(lacing) == 255 and (values or k + 1 < len(packets)):
                flush(False)
                cont = bool(values)
        if k == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return out


def store_samples(payload: bytes, frame: int = FRAME, rate: int = RATE, n_streams: int = 2) -> bytes:
    """8-bit samples as interleaved logical streams, to which frames are dealt in turn.

    Granule positions count samples from the start, so the reader's times put the frames in order.
    """
    serial = zlib.crc32(payload) & 0x7FFFFFFF
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    pages: list[tuple[int, int, int, bytes]] = []
    for own in range(n_streams):
        dealt = frames[own::n_streams]
        head = CODEC + struct.pack("<IIQ", rate, frame, len(payload))
        granules = [0] + [min(len(payload), (n_streams * j + own + 1) * frame) for j in range(len(dealt))]
        got = stream_pages(serial + own, [head, *dealt], granules)
        pages += [(0 if k == 0 else 1, g, own, p) for k, (g, p) in enumerate(got)]
    return b"".join(p for *_, p in sorted(pages, key=lambda x: x[:3]))


@dataclass
class Stream:
    serial: int
    pages: int = 0
    ended: bool = False
    lost: int = 0
    packets: list[bytes] = field(default_factory=list)
    #: End position of each packet in samples, or None where the container tells none.
    granules: list[int | None] = field(default_factory=list)
    _open: bytes | None = None
    _next: int = 0


def read_streams(media: bytes | None) -> tuple[dict[int, Stream], int]:
    """Logical streams of a container by serial number, and the number of damaged pages."""
    streams: dict[int, Stream] = {}
    bad = at = 0
    media = media or b""
    while (at := media.find(CAPTURE, at)) >= 0:
        if at + 27 > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBQIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media) or page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            bad += 1
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        _add_page(s, flags, granule, number, lacing, media, at + 27 + n)
        at = end
    return streams, bad


def _add_page(s: Stream, flags: int, granule: int, number: int, lacing: bytes, media: bytes, at: int) -> None:
    s.pages += 1
    s.ended |= bool(flags & LAST)
    gap = number != s._next
    s._next = number + 1
    if gap:
        s.lost += 1
    if gap or not flags & CONTINUED:
        s._open = None
    skip = bool(flags & CONTINUED) and s._open is None
    first, start = len(s.packets), at
    for v in lacing:
        at += v
        if v < 255:
            if skip:
                skip = False
            else:
                s.packets.append((s._open or b"") + media[start:at])
            s._open, start = None, at
    if lacing and lacing[-1] == 255 and not skip:
        s._open = (s._open or b"") + media[start:at]
    done = len(s.packets) - first
    s.granules += [None] * max(0, done - 1) + [granule if granule != NO_GRANULE else None] * (done > 0)


def is_samples(s: Stream) -> bool:
    return bool(s.packets) and s.packets[0].startswith(CODEC) and len(s.packets[0]) >= len(CODEC) + 16


def timed_frames(s: Stream, n_streams: int) -> list[tuple[int, bytes]]:
    """(start position, samples) of the packets of one of a file's ``n_streams`` sample streams.

    A page tells the end of its last packet only. A packet of 8-bit samples lasts as many positions as
    it has bytes, and between two packets of a stream the other streams have a frame each, so earlier
    packets follow backwards from that end.
    """
    if not is_samples(s):
        return []
    _, frame, _ = struct.unpack_from("<IIQ", s.packets[0], len(CODEC))
    out: list[tuple[int, bytes]] = []
    end: int | None = None
    for p, g in zip(reversed(s.packets[1:]), reversed(s.granules[1:])):
        end = g if g is not None else end
        if end is not None:
            out.append((end - len(p), p))
            end = out[-1][0] - (n_streams - 1) * frame
    return out[::-1]


def samples(media: bytes | None) -> tuple[bytes, dict]:
    """Samples of all sample streams in time order, and counts."""
    streams, bad = read_streams(media)
    n = sum(map(is_samples, streams.values()))
    frames = sorted(((t, s.serial, p) for s in streams.values() for t, p in timed_frames(s, n)))
    info = {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "bad": bad}
    return b"".join(p for *_, p in frames), info


def pad(text: str | None, unit: int = FRAME) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % unit if raw else unit)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """(id, n_bytes, media): each text (null: empty) as an Ogg container of 8-bit samples in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                padded = [pad(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in padded], pa.int64()), pa.array([store_samples(p) for _, p in padded], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(payload: bytes, info: dict, rate: int = RATE) -> str:
    """Counts, duration, mean, standard deviation and level changes of the samples, as text."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return f"streams={info['streams']};pages={info['pages']};packets={info['packets']};ms=0;mean=0.000;sd=0.000;turns=0"
    hist = np.bincount(x, minlength=256)
    level = np.arange(256)
    mean = float(hist @ level) / len(x)
    sd = max(0.0, float(hist @ (level * level)) / len(x) - mean * mean) ** 0.5
    high = x >= 128
    return f"streams={info['streams']};pages={info['pages']};packets={info['packets']};ms={len(x) * 1000 // rate};mean={mean:.3f};sd={sd:.3f};turns={int(np.count_nonzero(high[1:] != high[:-1]))}"


def decode_media(media: DataFrame, batch: int = 256) -> DataFrame:
    """Digest of a media column: sizes and checksums of the stored form and of the samples read back, and features."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("bad_pages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                out = []
                for row in b.slice(k, batch).to_pylist():
                    m = row["media"] or b""
                    payload, info = samples(m)
                    out.append({"doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": features(payload, info), "bad_pages": info["bad"]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long")
