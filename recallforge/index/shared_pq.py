"""Shared basis with product quantization (optionally rotated) of what the grain's coordinates leave."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.quantize import quantize_np, scale_np
from ..functions.stats import l2, pca

LLOYD = 20


@dataclass
class SharedPQ:
    basis: np.ndarray
    rotation: np.ndarray
    books: list[np.ndarray]
    bits: int

    @property
    def parts(self) -> int:
        return len(self.books)

    def codes(self, left: np.ndarray) -> np.ndarray:
        """One code per part of each residual."""
        z = np.array_split(left @ self.rotation.T, self.parts, axis=1)
        return np.stack([l2(p, b).argmin(axis=1) for p, b in zip(z, self.books)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1) @ self.rotation


@dataclass
class SharedGrain:
    """A grain's choice of the shared directions with the most variance, with 8-bit coordinates."""

    mean: np.ndarray
    columns: np.ndarray
    scale: np.ndarray

    def coords(self, shared: SharedPQ, x: np.ndarray) -> np.ndarray:
        return quantize_np((x - self.mean) @ shared.basis[self.columns].T, self.scale, "i8")

    def base(self, shared: SharedPQ, coords: np.ndarray) -> np.ndarray:
        return self.mean + (coords * self.scale) @ shared.basis[self.columns]


def _book(z: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(size) * max(1, len(z) // size) % len(z)
    book = z[at].copy()
    for _ in range(LLOYD):
        own = l2(z, book).argmin(axis=1)
        new = np.array([z[own == c].mean(axis=0) if (own == c).any() else book[c] for c in range(size)])
        if np.allclose(new, book):
            break
        book = new
    return book


def train(x: np.ndarray, grains: np.ndarray, local_dim: int, parts: int, bits: int = 8, rotate: bool = False) -> tuple[SharedPQ, dict[int, SharedGrain]]:
    """Shared model and grains from a bounded sample x with its clusters. Books have 2 ** bits entries;
    with fewer rows entries repeat."""
    dim = x.shape[1]
    basis, _ = pca(x, dim)
    own: dict[int, SharedGrain] = {}
    left = np.zeros_like(x)
    for g in np.unique(grains):
        rows = grains == g
        mean = x[rows].mean(axis=0)
        p = (x[rows] - mean) @ basis.T
        columns = np.sort(np.argsort(-p.var(axis=0), kind="stable")[:local_dim])
        own[int(g)] = SharedGrain(mean, columns, scale_np(p[:, columns], "i8"))
    empty = SharedPQ(basis, np.eye(dim), [], bits)
    for g, grain in own.items():
        rows = grains == g
        left[rows] = x[rows] - grain.base(empty, grain.coords(empty, x[rows]))
    rotation = pca(left, dim, centred=False)[0] if rotate else np.eye(dim)
    books = [_book(z, 1 << bits) for z in np.array_split(left @ rotation.T, parts, axis=1)]
    return SharedPQ(basis, rotation, books, bits), own


def reconstruct(shared: SharedPQ, grain: SharedGrain, coords: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return grain.base(shared, coords) + shared.decode(codes)
