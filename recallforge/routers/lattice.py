"""Lattice and hierarchical lattice routers over centroids."""

from __future__ import annotations

import numpy as np

from ..functions.stats import pca
from ..functions.zorder import zorder
from .blocks import guard

LATTICE_DIMS = 6


class Lattice:
    """Centroids projected to a few principal directions and rounded to cells of `spacing`."""

    def __init__(self, centroids: np.ndarray, dims: int = LATTICE_DIMS, spacing: float = 1.0):
        if spacing <= 0:
            raise ValueError("spacing is positive")
        self.c, self.spacing, self.settings = guard(centroids), spacing, {"dims": dims, "spacing": spacing}
        self.basis, _ = pca(self.c, min(dims, LATTICE_DIMS, self.c.shape[1]))
        self.cells = np.rint(self.c @ self.basis.T / spacing)

    def route(self, q: np.ndarray, nprobe: int) -> np.ndarray:
        """The nprobe centroids whose cells are nearest to the query's unrounded place."""
        d = ((self.cells - np.asarray(q, float) @ self.basis.T / self.spacing) ** 2).sum(axis=1)
        return np.lexsort((np.arange(len(d)), d))[:nprobe]


class HierarchicalLattice:
    """Layers of principal directions of what the layer before left; integer cells of all layers make
    one Z-order key. A window around the query's place in key order is ranked by cell distance."""

    def __init__(self, centroids: np.ndarray, layers: tuple[int, ...] = (4, 4), spacing: float | tuple[float, ...] | None = None):
        self.c, self.settings = guard(centroids), {"layers": tuple(layers), "spacing": spacing}
        self.mean = self.c.mean(axis=0)
        left, self.bases, self.spacings, cells, self.residual_energy = self.c - self.mean, [], [], [], [float(((self.c - self.mean) ** 2).sum())]
        for i, dims in enumerate(layers):
            basis, _ = pca(left, min(dims, left.shape[1]), centred=False)
            y = left @ basis.T
            given = spacing[i] if isinstance(spacing, tuple) else spacing
            step = float(given) if given else float(np.median(np.abs(y)) / 64 or 1.0)
            self.bases.append(basis)
            self.spacings.append(step)
            cells.append(np.rint(y / step))
            left = left - y @ basis
            self.residual_energy.append(float((left**2).sum()))
        self.cells = np.concatenate(cells, axis=1)
        keys = zorder(self.cells)
        self.order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], i)))
        self.keys = [keys[i] for i in self.order]

    def cell(self, q: np.ndarray) -> np.ndarray:
        left, out = np.asarray(q, float) - self.mean, []
        for basis, step in zip(self.bases, self.spacings):
            y = left @ basis.T
            out.append(np.rint(y / step))
            left = left - y @ basis
        return np.concatenate(out)

    def route(self, q: np.ndarray, nprobe: int) -> np.ndarray:
        from bisect import bisect_left

        cell = self.cell(q)
        at, width = bisect_left(self.keys, zorder(cell[None, :])[0]), max(16 * nprobe, 128)
        lo = max(0, min(at - width // 2, len(self.order) - width))
        window = self.order[lo : lo + width]
        d = ((self.cells[window] - cell) ** 2).sum(axis=1)
        return window[np.lexsort((window, d))][:nprobe]

    def route_many(self, queries: np.ndarray, nprobe: int) -> list[np.ndarray]:
        return [self.route(q, nprobe) for q in queries]


def refined(router, centroids: np.ndarray, q: np.ndarray, nprobe: int) -> np.ndarray:
    """Order of all grains for an index: what the router proposes by exact distance, the others by number."""
    n = len(centroids)
    found = router.route(q, min(2 * nprobe + 16, n))
    d = ((centroids[found] - q) ** 2).sum(axis=1)
    first = found[np.lexsort((found, d))]
    return np.concatenate([first, np.setdiff1d(np.arange(n), first)])
