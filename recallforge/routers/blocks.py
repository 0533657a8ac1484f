"""Balanced blocks, seeds and coverage: sequential algorithms over a bounded matrix on the driver or in
one task. GUARD bounds it; larger inputs are to be sampled first."""

from __future__ import annotations

import numpy as np

from ..functions.stats import l2

GUARD = 200_000


def guard(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    if x.ndim != 2 or not len(x) or not x.shape[1]:
        raise ValueError("a non-empty matrix is needed")
    if len(x) > GUARD:
        raise ValueError(f"{len(x)} rows; sample down to {GUARD}")
    return x


def farthest_first(x: np.ndarray, k: int, start: int | None = None) -> np.ndarray:
    """Row numbers of k seeds: the row nearest to the mean (or `start`), then always the row farthest
    from those chosen; ties by row."""
    first = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if start is None else start
    seeds, far = [first], ((x - x[first]) ** 2).sum(axis=1)
    while len(seeds) < min(k, len(x)):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    return np.array(seeds)


def with_capacity(d: np.ndarray, cap: int, largest_first: bool) -> np.ndarray:
    """Cluster of each row of a distance matrix under a capacity, by margin between best and second."""
    n, k = d.shape
    order = np.argsort(d, axis=1, kind="stable")
    best = np.take_along_axis(d, order[:, :2], 1)
    margin = best[:, 1] - best[:, 0] if k > 1 else np.zeros(n)
    rows = np.lexsort((np.arange(n), -margin if largest_first else margin))
    room, out = np.full(k, cap), np.full(n, -1)
    for r in rows:
        for c in order[r]:
            if room[c]:
                out[r], room[c] = c, room[c] - 1
                break
    return out


def balanced_blocks(x: np.ndarray, size: int, rounds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(row numbers of each block, block means): blocks of at most `size` rows, in the order of the
    first coordinate of their mean."""
    x = guard(x)
    if size < 1:
        raise ValueError("block size is at least 1")
    k = -(-len(x) // size)
    means = x[farthest_first(x, k)]
    for _ in range(max(1, rounds)):
        own = with_capacity(l2(x, means), size, largest_first=False)
        means = np.array([x[own == c].mean(axis=0) if (own == c).any() else means[c] for c in range(k)])
    blocks = [np.flatnonzero(own == c) for c in range(k)]
    keep = [c for c in range(k) if len(blocks[c])]
    keep.sort(key=lambda c: (means[c][0], c))
    return [blocks[c] for c in keep], means[keep]


def sample_rows(n: int, k: int) -> np.ndarray:
    """k row numbers spread evenly over n."""
    return np.unique(np.linspace(0, n - 1, min(k, n)).astype(int))


def exact_topk(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    d = ((x - q) ** 2).sum(axis=1)
    return np.lexsort((np.arange(len(x)), d))[:k]


def coverage(found: list[np.ndarray], truth: list[np.ndarray]) -> float:
    """Mean share of the true rows that are among the found ones."""
    return float(np.mean([len(np.intersect1d(f, t)) / max(1, len(t)) for f, t in zip(found, truth)]))
