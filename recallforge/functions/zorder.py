"""Space-filling keys as binary values that sort as unsigned numbers."""

from __future__ import annotations

import numpy as np


def zorder(coords: np.ndarray) -> list[bytes]:
    """Keys of i16 rows: each coordinate shifted to unsigned, bits interleaved from the highest on,
    coordinate by coordinate."""
    c = (np.clip(np.asarray(coords, np.int64), -32768, 32767) + 32768).astype(np.uint32)
    bits = (c[:, None, :] >> np.arange(15, -1, -1)[None, :, None]) & 1
    return [r.tobytes() for r in np.packbits(bits.reshape(len(c), -1).astype(np.uint8), axis=1)]


def morton(coords: np.ndarray) -> list[bytes]:
    """16-byte Morton keys of the first 16 coordinates, min(16, 128 / dims) low bits each; of each level of bits the
    first coordinate's is the highest."""
    c = np.asarray(coords, np.int64)[:, :16] + 32768
    width = min(16, 128 // max(1, c.shape[1]))
    bits = ((c[:, None, :] >> np.arange(width - 1, -1, -1)[None, :, None]) & 1).reshape(len(c), -1).astype(np.uint8)
    padded = np.concatenate([np.zeros((len(c), 128 - bits.shape[1]), np.uint8), bits], axis=1)
    return [r.tobytes() for r in np.packbits(padded, axis=1)]


def gray(n: int) -> int:
    return n ^ n >> 1


def hilbert(point: list[int], bits: int) -> int:
    """Distance along a Hilbert curve of `bits` bits per coordinate (transpose form)."""
    x, n, top = list(point), len(point), 1 << bits - 1
    q = top
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v ^ t) >> bit & 1
    return out
