"""Landmark postings, spill trees, space-filling-curve orders and chunked rerank."""

from __future__ import annotations

import numpy as np

from ..functions.stats import l2, pca
from ..functions.zorder import gray, hilbert
from ..index.kmeans import balanced
from ..routers.blocks import farthest_first, guard


def ranked(x: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    rows = np.unique(rows)
    return rows[np.lexsort((rows, ((x[rows] - q) ** 2).sum(axis=1)))][:k]


class Landmarks:
    """Every row is posted at its nearest `top` landmarks; a list longer than `cap` spills to the next
    nearest landmark with room."""

    def __init__(self, x: np.ndarray, count: int = 128, top: int = 2, cap: int | None = None, probes: int = 8):
        self.x, self.probes = guard(x), probes
        self.marks = self.x[farthest_first(self.x, min(count, len(self.x)))]
        order = np.argsort(l2(self.x, self.marks), axis=1, kind="stable")
        self.lists: list[list[int]] = [[] for _ in self.marks]
        for r in range(len(self.x)):
            done = 0
            for m in order[r]:
                if cap is None or len(self.lists[m]) < cap:
                    self.lists[m].append(r)
                    done += 1
                    if done == top:
                        break

    def route(self, q: np.ndarray, k: int) -> np.ndarray:
        near = np.argsort(((self.marks - q) ** 2).sum(axis=1), kind="stable")[: self.probes]
        rows = [r for m in near for r in self.lists[m]]
        return ranked(self.x, np.array(rows, int), q, k)


class SpillTree:
    """Tree of balanced means. Children are scored by their means, exactly or in a node's principal
    directions plus the mean's distance from them; beam * spill nodes go on."""

    def __init__(self, x: np.ndarray, fanout: int = 8, leaf: int = 32, beam: int = 4, spill: int = 4, dims: int | None = None):
        self.x, self.fanout, self.leaf, self.wide, self.dims = guard(x), fanout, leaf, beam * spill, dims
        self.root = self._build(np.arange(len(self.x)))

    def _build(self, rows: np.ndarray) -> dict:
        if len(rows) <= self.leaf:
            return {"rows": rows, "children": []}
        own = balanced(self.x[rows], min(self.fanout, len(rows)))
        parts = [rows[own == c] for c in np.unique(own)]
        if len(parts) < 2:
            return {"rows": rows, "children": []}
        means = np.array([self.x[p].mean(axis=0) for p in parts])
        node = {"rows": rows, "children": [self._build(p) for p in parts], "means": means}
        if self.dims:
            centre = means.mean(axis=0)
            basis, _ = pca(means, min(self.dims, means.shape[1]))
            flat = (means - centre) @ basis.T
            node |= {"centre": centre, "basis": basis, "flat": flat, "left": ((means - centre) ** 2).sum(axis=1) - (flat**2).sum(axis=1)}
        return node

    def _scores(self, node: dict, q: np.ndarray) -> np.ndarray:
        if not self.dims:
            return ((node["means"] - q) ** 2).sum(axis=1)
        return ((node["flat"] - (q - node["centre"]) @ node["basis"].T) ** 2).sum(axis=1) + node["left"]

    def route(self, q: np.ndarray, k: int) -> np.ndarray:
        q, level = np.asarray(q, float), [self.root]
        while any(n["children"] for n in level):
            scored = [(0.0, i, 0, n) for i, n in enumerate(level) if not n["children"]]
            for i, n in enumerate(level):
                if n["children"]:
                    scored += [(float(s), i, j, c) for j, (s, c) in enumerate(zip(self._scores(n, q), n["children"]))]
            level = [s[3] for s in sorted(scored, key=lambda s: s[:3])[: self.wide]]
        return ranked(self.x, np.concatenate([n["rows"] for n in level]), q, k)


class CurveOrder:
    """Rows in the order of a one-dimensional key of their principal coordinates; a window is scanned."""

    def __init__(self, x: np.ndarray, kind: str = "hilbert", dims: int = 4, bits: int = 8, window: int = 256):
        self.x, self.kind, self.bits, self.window = guard(x), kind, bits, window
        self.mean = self.x.mean(axis=0)
        self.basis, _ = pca(self.x, min(dims, self.x.shape[1]))
        y = (self.x - self.mean) @ self.basis.T
        self.low, self.high = y.min(axis=0), y.max(axis=0)
        keys = [self.key(p) for p in y]
        self.order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], i)))
        self.keys = [keys[i] for i in self.order]

    def key(self, y: np.ndarray) -> int:
        top = (1 << self.bits) - 1
        cell = np.clip((y - self.low) / np.where(self.high > self.low, self.high - self.low, 1.0) * top, 0, top).astype(int).tolist()
        if self.kind == "hilbert":
            return hilbert(cell, self.bits)
        if self.kind == "trie":  # first coordinate first
            return sum(c << self.bits * (len(cell) - 1 - i) for i, c in enumerate(cell))
        if self.kind == "gray":
            cell = [gray(c) for c in cell]
        key = 0
        for bit in range(self.bits - 1, -1, -1):
            for c in cell:
                key = key << 1 | c >> bit & 1
        return key

    def route(self, q: np.ndarray, k: int) -> np.ndarray:
        from bisect import bisect_left

        at = bisect_left(self.keys, self.key((q - self.mean) @ self.basis.T))
        lo = max(0, min(at - self.window // 2, len(self.order) - self.window))
        return ranked(self.x, self.order[lo : lo + self.window], q, k)


def chunked_rerank(x: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int, chunk: int = 16, slack: float = 2.2) -> np.ndarray:
    """The k nearest of rows by partial sums of `chunk` dimensions at a time; rows whose partial sum is
    over slack times the k-th best, scaled to the dimensions seen, are dropped (approximate)."""
    alive, part = np.asarray(rows), np.zeros(len(rows))
    for lo in range(0, x.shape[1], chunk):
        part = part + ((x[alive, lo : lo + chunk] - q[lo : lo + chunk]) ** 2).sum(axis=1)
        if len(alive) > k and lo + chunk < x.shape[1]:
            keep = part <= np.partition(part, k - 1)[k - 1] * slack
            alive, part = alive[keep], part[keep]
    return alive[np.lexsort((alive, part))][:k]
