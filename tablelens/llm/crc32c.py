"""CRC-32C of many byte strings at once, in numpy: blocks are reduced column by column, block sums are
joined by the linear map that appends zero bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_POLY = 0x82F63B78  # fixed: the reflected Castagnoli polynomial
_MASK = 0xA282EAD8  # fixed: the delta of masked checksums
_BLOCK = 64


def _tables(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A linear map of 32 bits, given by its images of the unit vectors, as two 16-bit tables."""
    out = []
    for half in (images[:16], images[16:]):
        t = np.zeros(1, dtype=np.uint32)
        for x in half:
            t = np.concatenate([t, t ^ x])
        out.append(t)
    return out[0], out[1]


def _apply(tables, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 0xFFFF] ^ tables[1][x >> np.uint32(16)]


@lru_cache(maxsize=64)
def _append_zeros(k: int):
    """Tables of the map that appends 2**k zero bytes."""
    units = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    if k == 0:
        x = units
        for _ in range(8):
            x = (x >> np.uint32(1)) ^ np.where(x & 1, np.uint32(_POLY), np.uint32(0))
        return _tables(x.astype(np.uint32))
    half = _append_zeros(k - 1)
    return _tables(_apply(half, _apply(half, units)))


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The checksum of each part, as uint32."""
    lens = np.array([len(p) for p in parts], dtype=np.int64)
    blocks = -(-lens // _BLOCK)
    pads = (blocks * _BLOCK - lens).tolist()  # zeros in front leave a raw sum as it is
    flat = np.frombuffer(b"".join([b"\0" * n + p for n, p in zip(pads, parts)]), dtype="<u4").reshape(-1, _BLOCK // 4)
    raw = np.zeros(len(flat), dtype=np.uint32)
    word = _append_zeros(2)
    for j in range(_BLOCK // 4):
        raw = _apply(word, raw ^ flat[:, j])
    m, level = blocks.copy(), 6
    while len(m) and m.max() > 1:  # join neighbours
        half = (m + 1) // 2
        to = np.repeat(2 * (np.cumsum(half) - half) + 2 * half - m, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = np.zeros(2 * int(half.sum()), dtype=np.uint32)
        wide[to] = raw
        raw = _apply(_append_zeros(level), wide[0::2]) ^ wide[1::2]
        m, level = half, level + 1
    one = np.zeros(len(parts), dtype=np.uint32)
    one[m > 0] = raw
    start = np.full(len(parts), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(lens.max(initial=0)).bit_length()):
        on = (lens >> k) & 1 == 1
        start[on] = _apply(_append_zeros(k), start[on])
    return one ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)
