"""One grain: mean, principal basis, integer coordinates, residual norm and residual sketches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.quantize import quantize_np, residual_levels_np, residual_np, scale_np
from ..functions.stats import pca


@dataclass
class Grain:
    mean: np.ndarray
    basis: np.ndarray
    scale: np.ndarray
    norm_scale: float
    sketch_basis: np.ndarray
    sketch_scale: np.ndarray
    bits: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coords, residual, sketch) of rows, with the grain's parameters."""
        y = x - self.mean
        coords = quantize_np(y @ self.basis.T, self.scale)
        left = y - (coords * self.scale) @ self.basis
        residual = quantize_np((left**2).sum(axis=1), self.norm_scale, "u16")
        z = left @ self.sketch_basis.T
        sketch = residual_levels_np(z, self.sketch_scale, self.bits)
        return coords, residual, sketch

    def decode(self, coords: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        return self.mean + (coords * self.scale) @ self.basis + (sketch * self.sketch_scale) @ self.sketch_basis

    def left_over(self, residual: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """Squared norm that the sketch doesn't account for."""
        return np.maximum(residual * self.norm_scale - ((sketch * self.sketch_scale) ** 2).sum(axis=1), 0.0)

    def weights(self) -> tuple[float, np.ndarray, int, np.ndarray]:
        """(unit, integer weights of coords, of the residual, of the sketch) for integer scores."""
        parts = np.concatenate([self.scale**2, [self.norm_scale], self.sketch_scale**2])
        unit = max(float(parts[parts > 0].min()), float(parts.max()) / (2**31 - 1))
        w = lambda s, most: np.clip(np.floor(s / unit + 0.5), 1, most).astype(np.int64)
        return unit, w(self.scale**2, 32767), int(w(np.array([self.norm_scale]), 2**32 - 1)[0]), w(self.sketch_scale**2, 8388607)

    def scores(self, q: np.ndarray, coords: np.ndarray, residual: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """Approximate squared distances, queries by rows: integer sums of residuals, coordinate and sketch
        differences, as products of matrices of whole numbers."""
        qc, qr, qs = self.encode(np.atleast_2d(q))
        unit, wc, wr, ws = self.weights()

        def weighed(a, b, w):
            a, b, w = a.astype(float), b.astype(float), w.astype(float)
            return (a * a * w).sum(axis=1)[:, None] - 2.0 * (a * w) @ b.T + (b * b * w).sum(axis=1)[None, :]

        return ((qr[:, None] + residual[None, :]) * float(wr) + weighed(qc, coords, wc) + weighed(qs, sketch, ws)) * unit


def train(x: np.ndarray, local_dim: int, sketch_dim: int, bits: int) -> Grain:
    mean = x.mean(axis=0)
    y = x - mean
    basis, _ = pca(y, local_dim, centred=False)
    p = y @ basis.T
    scale = scale_np(p)
    left = y - (quantize_np(p, scale) * scale) @ basis
    norm_scale = float(scale_np((left**2).sum(axis=1)[:, None], "u16")[0])
    sketch_basis, _ = pca(left, sketch_dim, centred=False) if sketch_dim else (np.zeros((0, x.shape[1])), None)
    _, sketch_scale = residual_np(left @ sketch_basis.T, bits)
    return Grain(mean, basis, scale, norm_scale, sketch_basis, np.asarray(sketch_scale, float), bits)


def adaptive_shape(x: np.ndarray, target: float, local: tuple[int, int], sketch: tuple[int, int], bits: int, most_bits: int) -> tuple[int, int, int]:
    """(local_dim, sketch_dim, bits) for the directions that hold `target` of the axis variances."""
    v = np.sort(x.var(axis=0))[::-1]
    total = v.sum()
    dims = int(np.searchsorted(np.cumsum(v), target * total - 1e-12) + 1) if total > 0 else 1
    n_local = int(np.clip(dims, local[0], min(local[1], x.shape[1])))
    n_sketch = int(np.clip(dims - n_local, sketch[0], min(sketch[1], x.shape[1])))
    return n_local, n_sketch, most_bits if dims > n_local + n_sketch or n_local == local[1] else bits
