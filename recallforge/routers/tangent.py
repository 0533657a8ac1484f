"""Tangent tree: nodes with local principal charts, routed by beam search on integer chart keys."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.stats import pca
from ..functions.zorder import morton
from .blocks import guard

GAP = 3000


@dataclass(frozen=True)
class TangentConfig:
    levels: int = 3
    chart_dim: int = 4
    beam: int = 4
    candidate_pool: int = 256
    final_nprobe: int = 32
    spacing: float | None = None


def segment_config(n: int, dim: int) -> TangentConfig:
    return TangentConfig(3 if n >= 8 else 2, min(max(dim, 1), 4), 4, min(max(n, 1), 256), min(max(n, 1), 32))


@dataclass
class Node:
    rows: np.ndarray
    mean: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)
    keys: np.ndarray | None = None


class TangentTree:
    """spacing: width of a chart cell; by default the median projection over 64, 1.0 rounds to whole
    numbers."""

    def __init__(self, x: np.ndarray, config: TangentConfig = TangentConfig()):
        self.x, self.config = guard(x), config
        if config.spacing:
            self.spacing = config.spacing
        else:
            basis, _ = pca(self.x, min(config.chart_dim, self.x.shape[1]))
            y = np.abs((self.x - self.x.mean(axis=0)) @ basis.T)
            self.spacing = float(np.median(y) / 64) or 1.0
        hops = max(1, config.levels - 1)
        self.fanout = max(2, int(np.ceil(round(len(self.x) ** (1.0 / hops), 9))))
        self.root = self._build(np.arange(len(self.x)), hops)

    def _keys(self, node: Node, points: np.ndarray) -> np.ndarray:
        return np.rint((points - node.mean) @ node.basis.T / self.spacing)

    def _build(self, rows: np.ndarray, hops: int) -> Node:
        own = self.x[rows]
        mean = own.mean(axis=0)
        basis, values = pca(own, min(self.config.chart_dim, self.x.shape[1]))
        node = Node(rows, mean, basis, values, float(np.sqrt(((own - mean) ** 2).sum(axis=1).max())))
        if hops and len(rows) > 1:
            keys = self._keys(node, own)
            order = np.lexsort((rows, *keys.T[::-1]))
            parts = [p for p in np.array_split(rows[order], min(self.fanout, len(rows))) if len(p)]
            if len(parts) > 1:
                children = [self._build(p, hops - 1) for p in parts]
                centres = self._keys(node, np.array([c.mean for c in children]))
                codes = morton(np.clip(centres, -32768, 32767))
                at = sorted(range(len(children)), key=lambda i: (codes[i], i))
                node.children, node.keys = [children[i] for i in at], centres[at]
        return node

    def route(self, q: np.ndarray, final_nprobe: int | None = None) -> tuple[np.ndarray, bool]:
        """(rows, nearest first; whether too few were reached)."""
        q, beam = np.asarray(q, float), [self.root]
        nprobe = self.config.final_nprobe if final_nprobe is None else final_nprobe
        while any(n.children for n in beam):
            scored = []
            for i, n in enumerate(beam):
                if not n.children:
                    scored.append((0.0, i, 0, n))
                    continue
                d = ((n.keys - self._keys(n, q[None, :])) ** 2).sum(axis=1)
                scored += [(float(v), i, j, c) for j, (v, c) in enumerate(zip(d, n.children))]
            scored.sort(key=lambda s: s[:3])
            sure = len(scored) > 1 and scored[1][0] - scored[0][0] > GAP
            beam = [s[3] for s in scored[: 1 if sure and self.config.spacing == 1.0 else self.config.beam]]
        rows = np.unique(np.concatenate([n.rows for n in beam]))[: self.config.candidate_pool]
        d = ((self.x[rows] - q) ** 2).sum(axis=1)
        found = rows[np.lexsort((rows, d))][:nprobe]
        return found, len(found) < min(nprobe, len(self.x))

    def route_many(self, queries: np.ndarray, final_nprobe: int | None = None) -> list[np.ndarray]:
        return [self.route(q, final_nprobe)[0] for q in queries]

    def nodes(self) -> list[Node]:
        out, todo = [], [self.root]
        while todo:
            out.append(todo.pop())
            todo += out[-1].children
        return out

    def resident_bytes(self) -> int:
        return 4 * self.x.size + sum(4 * (n.mean.size + n.basis.size + n.values.size + 1) + (8 * n.keys.size if n.keys is not None else 0) + 4 * len(n.rows) * (not n.children) for n in self.nodes())

    def diagnostics(self) -> dict:
        """Directions that hold 80, 90, 95 % of the root's variance; how radii shrink; how far apart
        sibling charts are (10th and 25th percentile, nearest rank)."""
        _, values = pca(self.x, self.x.shape[1])
        share = np.cumsum(values) / max(values.sum(), 1e-30)
        pairs = [(n, c) for n in self.nodes() for c in n.children]
        gaps = sorted(float(np.sqrt(((n.keys[i] - n.keys[j]) ** 2).sum())) for n in self.nodes() if n.children for i in range(len(n.children)) for j in range(i))
        rank = lambda p: gaps[min(len(gaps) - 1, int(np.ceil(p * len(gaps))) - 1)] if gaps else 0.0
        return {**{f"d{p}": int(np.searchsorted(share, p / 100 - 1e-12) + 1) for p in (80, 90, 95)}, "radius_shrink": float(np.mean([c.radius / n.radius for n, c in pairs if n.radius > 0])) if pairs else 1.0, "separation_p10": rank(0.10), "separation_p25": rank(0.25)}


def build_for_segment(x: np.ndarray) -> TangentTree:
    return TangentTree(x, segment_config(len(x), np.asarray(x).shape[1]))
