"""Quantization: integer codes with scales, residual sketches, packing, half floats.

Column forms are for plans, array forms (numpy) for Arrow functions; both round half to even, except
eight-bit scalar quantization of cold vectors, which rounds half away from zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

LIMITS = {"i16": (-32768, 32767), "i8": (-128, 127), "u16": (0, 65535)}
TOP = {"i16": 32767.0, "i8": 127.0, "u16": 65535.0}


def quantize(x: Column, scale: Column, kind: str = "i16") -> Column:
    """clamp(round half even(x / scale)); a scale that isn't positive divides by nothing."""
    lo, hi = LIMITS[kind]
    y = F.rint(F.when(scale > 0, x / scale).otherwise(x))
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), y)).cast("int")


def scale_of(values: Column, kind: str = "i16") -> Column:
    """Scale that takes the largest value of an array to the end of the range; 1.0 for zeros."""
    top = F.array_max(F.transform(values, lambda v: v.cast("double") if kind == "u16" else F.abs(v.cast("double"))))
    return F.when(top > 0, top / F.lit(TOP[kind])).otherwise(F.lit(1.0))


def integer_weight(scale: Column, unit: Column, most: int) -> Column:
    """clamp(round half away(scale / unit), 1, most); 1 where either isn't positive."""
    weight = F.greatest(F.lit(1), F.least(F.lit(most), F.round(F.try_divide(scale, unit)))).cast("long")
    return F.when((scale > 0) & (unit > 0), weight).otherwise(F.lit(1).cast("long"))


def sq8_scale(vector: Column) -> Column:
    return scale_of(vector, "i8")


def sq8_codes(vector: Column, scale: Column) -> Column:
    """Eight-bit codes of a vector, rounded half away from zero."""
    return F.transform(vector, lambda v: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(v.cast("double") / scale))).cast("int"))


def sq8_decode(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: (c * scale).cast("float"))


def residual_level(x: Column, scale: Column, bits: int) -> Column:
    """Residual code: 1 bit gives the sign, 2 bits the levels -3, -1, 1, 3 (rounded half to even first), 8 bits an i8."""
    if bits == 1:
        return F.when(x >= 0, 1).otherwise(-1)
    if bits == 2:
        y = F.rint(F.when(scale > 0, x / scale).otherwise(x))
        return F.when(y < -2, -3).when(y < 0, -1).when(y < 2, 1).otherwise(3)
    return quantize(x, scale, "i8")


def quantize_np(x: np.ndarray, scale: np.ndarray | float, kind: str = "i16") -> np.ndarray:
    lo, hi = LIMITS[kind]
    s = np.where(np.asarray(scale) > 0, scale, 1.0)
    return np.clip(np.rint(x / s), lo, hi).astype(np.int64)


def scale_np(x: np.ndarray, kind: str = "i16", axis=0) -> np.ndarray:
    top = (x if kind == "u16" else np.abs(x)).max(axis=axis, initial=0.0)
    return np.where(top > 0, top / TOP[kind], 1.0)


def residual_levels_np(x: np.ndarray, scale: np.ndarray, bits: int) -> np.ndarray:
    """Residual codes at 1, 2 or 8 bits with given scales; decoding is codes * scale."""
    if bits == 1:
        return np.where(x >= 0, 1, -1)
    if bits == 2:
        y = np.rint(x / np.where(scale > 0, scale, 1.0))
        return np.select([y < -2, y < 0, y < 2], [-3, -1, 1], 3)
    if bits != 8:
        raise ValueError("residual bits are 1, 2 or 8")
    return quantize_np(x, scale, "i8")


def residual_np(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scale) of residual columns: the largest absolute value is the level at the end of the range."""
    top = np.abs(x).max(axis=0, initial=0.0)
    scale = scale_np(x, "i8") if bits == 8 else np.where(top > 0, top / {1: 1.0, 2: 3.0}.get(bits, 1.0), 1.0)
    return residual_levels_np(x, scale, bits), scale


@dataclass(frozen=True)
class Quantizer:
    """One finite, positive scale."""

    scale: float

    def __post_init__(self):
        if not (np.isfinite(self.scale) and self.scale > 0):
            raise ValueError("a scale is finite and positive")

    def quantize(self, x):
        return quantize_np(np.asarray(x, float), self.scale)

    def dequantize(self, codes):
        return np.asarray(codes, float) * self.scale


def pack_bits(levels: np.ndarray, bits: int) -> bytes:
    """Residual levels in 1 or 2 bits each, lowest bits first."""
    codes = (levels > 0).astype(np.uint8) if bits == 1 else ((levels + 3) // 2).astype(np.uint8)
    if bits == 2:
        codes = np.stack([codes & 1, codes >> 1], axis=-1).reshape(-1)
    return np.packbits(codes, bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].astype(np.int64)
    return flat * 2 - 1 if bits == 1 else (flat[0::2] + 2 * flat[1::2]) * 2 - 3


def pack_nibbles(codes: np.ndarray) -> bytes:
    """4-bit codes two a byte, low half first."""
    c = np.append(codes, np.zeros(len(codes) % 2, codes.dtype)).astype(np.uint8)
    return (c[0::2] | c[1::2] << 4).tobytes()


def unpack_nibbles(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.stack([b & 15, b >> 4], axis=-1).reshape(-1)[:n]


def f16_bytes(vector) -> bytes:
    """IEEE half floats, little-endian."""
    return np.asarray(vector, np.float32).astype("<f2").tobytes()


def f16_vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2").astype(np.float32)
