"""Baseline JPEG files from numpy arrays: 8-bit colour or gray, full resolution in every component.

The Huffman tables are not tuned to the picture: every DC category has a code of four bits and every pair of
run and size one of eight, which any reader takes from the file. Files are larger than they could be, not worse.
"""

from __future__ import annotations

import struct

import numpy as np

# The quantisation tables that quality 50 stands for, brightness and colour, row by row.
BRIGHT = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
COLOUR = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99]

#: Order of a block's coefficients by diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
DC = list(range(12))
AC = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
_AC_CODE = np.zeros(256, np.int64)
_AC_CODE[AC] = np.arange(len(AC))


def quantisation(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of 8x8 blocks in zigzag order; edges repeat to whole blocks."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    c = (basis @ b @ basis.T).reshape(-1, 64)
    return np.rint(c / table).astype(np.int64)[:, ZIGZAG]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits that a value's magnitude needs."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _scan(components: list[np.ndarray]) -> bytes:
    """Entropy-coded blocks, components in turn."""
    n = len(components)
    q = np.stack(components, axis=1).reshape(-1, 64)
    first = np.stack([np.diff(c[:, 0], prepend=0) for c in components], axis=1).ravel()
    size = _size(first)
    # (block, place, part) of every code, its bits and their number
    keys, codes, bits = [np.stack([np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)])], [size << size | np.where(first < 0, first + (1 << size) - 1, first)], [4 + size]
    block, place = np.nonzero(q[:, 1:])
    place = place + 1
    v = q[block, place]
    same = np.concatenate([[False], block[1:] == block[:-1]])
    gap = place - np.where(same, np.concatenate([[0], place[:-1]]), 0) - 1
    size = _size(v)
    keys.append(np.stack([block, place, np.full(len(v), 9)]))
    codes.append(_AC_CODE[(gap % 16) << 4 | size] << size | np.where(v < 0, v + (1 << size) - 1, v))
    bits.append(8 + size)
    far = np.repeat(np.arange(len(v)), gap // 16)
    keys.append(np.stack([block[far], place[far], np.arange(len(far)) % 4]))
    codes.append(np.full(len(far), _AC_CODE[0xF0]))
    bits.append(np.full(len(far), 8))
    last = np.zeros(len(q), np.int64)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    keys.append(np.stack([ends, np.full(len(ends), 64), np.zeros(len(ends), np.int64)]))
    codes.append(np.full(len(ends), _AC_CODE[0x00]))
    bits.append(np.full(len(ends), 8))
    key, code, count = np.concatenate(keys, axis=1), np.concatenate(codes), np.concatenate(bits)
    order = np.lexsort(key[::-1])
    code, count = code[order], count[order]
    start = np.cumsum(count) - count
    own = np.repeat(np.arange(len(code)), count)
    out = code[own] >> (count[own] - 1 - (np.arange(len(own)) - start[own])) & 1
    data = np.packbits(np.concatenate([out, np.ones(-len(out) % 8, np.int64)]).astype(np.uint8)).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def jpeg(pixels: np.ndarray, quality: int = 95) -> bytes:
    """A JPEG of (height, width) gray or (height, width, 3 or 4) colour, quality 1 to 100; alpha is dropped."""
    if not 1 <= quality <= 100:
        raise ValueError(f"quality {quality} is not in 1..100")
    h, w = pixels.shape[:2]
    p = pixels.astype(float)
    tables = [quantisation(BRIGHT, quality), quantisation(COLOUR, quality)]
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        planes = [p.reshape(h, w)]
    else:
        r, g, b = p[:, :, 0], p[:, :, 1], p[:, :, 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    n = len(planes)
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for k, t in enumerate(tables[: 1 + (n > 1)]):
        head += _segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist()))
    head += _segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(n)))
    head += _segment(0xC4, bytes([0x00, *(len(DC) * (k == 4) for k in range(1, 17)), *DC]))
    head += _segment(0xC4, bytes([0x10, *(len(AC) * (k == 8) for k in range(1, 17)), *AC]))
    head += _segment(0xDA, bytes([n, *(x for k in range(n) for x in (k + 1, 0x00)), 0, 63, 0]))
    return head + _scan([_blocks(x, tables[min(k, 1)]) for k, x in enumerate(planes)]) + b"\xff\xd9"
