"""PNG files of the forms that the JVM's reader gets wrong: 16 bits a channel, gray with alpha, gray with a clear level.

Values of 16 bits keep their high byte, gray of less than 8 bits is stretched to 0..255, palettes are
expanded, a clear colour or level becomes alpha, gray becomes three channels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Values of a pixel by colour type: gray, colour, palette, gray and alpha, colour and alpha.
VALUES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Interlaced passes: first column and row, and steps.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk of the PNG file is damaged")
        yield kind, body
        at += 12 + n


def _rows(raw: memoryview, height: int, size: int, step: int) -> np.ndarray:
    """Bytes of ``height`` rows without their filters; ``step`` is how far the byte to the left lies."""
    out = np.zeros((height, size), np.uint8)
    above = np.zeros(size, np.uint8)
    for y in range(height):
        kind, line = raw[y * (size + 1)], np.frombuffer(raw, np.uint8, size, y * (size + 1) + 1)
        if kind == 0:
            row = line
        elif kind == 1:
            padded = np.zeros(-(-size // step) * step, np.uint8)
            padded[:size] = line
            row = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:size]
        elif kind == 2:
            row = line + above
        else:
            row = _predicted(kind, line.tolist(), above.tolist(), step)
        out[y] = above = row
    return out


def _predicted(kind: int, line: list[int], above: list[int], step: int) -> np.ndarray:
    """A row whose bytes are told from their neighbours: by the mean of left and above, or by the nearest of three."""
    row = [0] * step + line
    up = [0] * step + above
    for i in range(step, len(row)):
        left, over, corner = row[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (left + over) // 2
        else:
            p = left + over - corner
            guess = min((left, over, corner), key=lambda v: abs(p - v))
        row[i] = (row[i] + guess) & 255
    return np.array(row[step:], np.uint8)


def _values(rows: np.ndarray, width: int, depth: int, n: int) -> np.ndarray:
    """(height, width, n) whole values."""
    if depth == 16:
        return rows.reshape(len(rows), width, n, 2).astype(np.int64) @ np.array([256, 1])
    if depth == 8:
        return rows.reshape(len(rows), width, n).astype(np.int64)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth) @ (1 << np.arange(depth)[::-1])
    return bits[:, : width * n].reshape(len(rows), width, n).astype(np.int64)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3 or 4) bytes of a PNG file; 4 where it has alpha or something clear."""
    head, palette, clear, packed = b"", b"", None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    n, raw = VALUES[kind], memoryview(zlib.decompress(b"".join(packed)))
    v = np.zeros((height, width, n), np.int64)
    at = 0
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = len(range(x0, width, dx)), len(range(y0, height, dy))
        if w and h:
            size = -(-w * n * depth // 8)
            v[y0::dy, x0::dx] = _values(_rows(raw[at:], h, size, max(1, n * depth // 8)), w, depth, n)
            at += h * (size + 1)
    if kind == 3:
        table = np.full((256, 4), 255, np.int64)
        table[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        table[: len(clear or b""), 3] = list(clear or b"")
        return table[v[:, :, 0]][:, :, : 3 if clear is None else 4].astype(np.uint8)
    alpha = None
    if kind in (4, 6):
        alpha, v = v[:, :, -1:], v[:, :, :-1]
    elif clear is not None:
        level = np.array(struct.unpack(f">{n}H", clear))
        alpha = np.where((v == level).all(axis=2, keepdims=True), 0, (1 << depth) - 1)

    def byte(x: np.ndarray) -> np.ndarray:
        return x >> 8 if depth == 16 else x * (255 // ((1 << depth) - 1))

    colour = byte(v) if v.shape[2] == 3 else np.repeat(byte(v), 3, axis=2)
    return (colour if alpha is None else np.concatenate([colour, byte(alpha)], axis=2)).astype(np.uint8)
