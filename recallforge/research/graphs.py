"""Graph routers over block means or points: neighbour lists, pruning rules, beam search."""

from __future__ import annotations

import numpy as np

from ..functions.stats import l2
from ..routers.blocks import balanced_blocks, farthest_first, guard


def neighbours(x: np.ndarray, m: int, rule: str = "diverse", alpha: float = 1.25) -> list[list[int]]:
    """At most m neighbours of each row. knn takes the nearest; diverse and rng keep a candidate only if
    it is farther than distance / alpha (1.0 for rng) from those kept; refused ones fill what is left."""
    x = guard(x)
    d = np.sqrt(l2(x, x))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    factor = 1.0 if rule == "rng" else alpha
    out = []
    for i in range(len(x)):
        near = [int(j) for j in order[i][: max(4 * m, m)] if np.isfinite(d[i, j])]
        if rule == "knn":
            out.append(near[:m])
            continue
        kept: list[int] = []
        for j in near:
            if len(kept) == m:
                break
            if all(d[j, k] >= d[i, j] / factor for k in kept):
                kept.append(j)
        kept += [j for j in near if j not in kept][: m - len(kept)]
        out.append(kept)
    return out


def beam_search(x: np.ndarray, edges: list[list[int]], q: np.ndarray, beam: int, rounds: int, starts: np.ndarray) -> np.ndarray:
    """Rows seen, nearest first."""
    dist = {int(i): float(((x[i] - q) ** 2).sum()) for i in starts}
    open_ = set(dist)
    for _ in range(rounds):
        front = sorted(open_, key=lambda i: (dist[i], i))[:beam]
        new = {j for i in front for j in edges[i]} - dist.keys()
        if not new:
            break
        dist |= {j: float(((x[j] - q) ** 2).sum()) for j in new}
        open_ = (open_ - set(front)) | new
    return np.array(sorted(dist, key=lambda i: (dist[i], i)))


class PointGraph:
    def __init__(self, x: np.ndarray, m: int = 16, rule: str = "diverse", beam: int = 16, rounds: int = 8):
        self.x, self.beam, self.rounds = guard(x), beam, rounds
        self.edges, self.starts = neighbours(self.x, m, rule), farthest_first(self.x, 8)

    def route(self, q: np.ndarray, k: int) -> np.ndarray:
        return beam_search(self.x, self.edges, np.asarray(q, float), self.beam, self.rounds, self.starts)[:k]


class BlockGraph:
    """The same over means of balanced blocks; rows of the best blocks are then scanned exactly."""

    def __init__(self, x: np.ndarray, size: int = 32, m: int = 8, rule: str = "diverse", beam: int = 8, rounds: int = 5, top: int = 8):
        self.x, self.beam, self.rounds, self.top = guard(x), beam, rounds, top
        self.blocks, self.means = balanced_blocks(self.x, size, 2)
        self.edges = neighbours(self.means, min(m, len(self.means) - 1), rule) if len(self.means) > 1 else [[]]
        self.starts = farthest_first(self.means, min(4, len(self.means)))

    def route(self, q: np.ndarray, k: int) -> np.ndarray:
        q = np.asarray(q, float)
        best = beam_search(self.means, self.edges, q, self.beam, self.rounds, self.starts)[: self.top]
        rows = np.concatenate([self.blocks[b] for b in best])
        return rows[np.lexsort((rows, ((self.x[rows] - q) ** 2).sum(axis=1)))][:k]
