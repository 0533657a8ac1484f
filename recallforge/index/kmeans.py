"""Clusterings of a bounded matrix: two means and balanced means."""

from __future__ import annotations

import numpy as np
from ..functions.stats import l2
from ..routers.blocks import farthest_first, guard, with_capacity

ROUNDS, SLACK = 20, 1.3


def two_means(x: np.ndarray) -> np.ndarray:
    """Cluster (0 or 1) of each row: seeds are the first row and the one farthest from it."""
    x = guard(x)
    means, own = x[farthest_first(x, 2, 0)], np.zeros(len(x), int)
    for _ in range(ROUNDS):
        new = l2(x, means).argmin(axis=1) if len(means) > 1 else own
        if (new == own).all() and _:
            break
        own = new
        means = np.array([x[own == c].mean(axis=0) if (own == c).any() else means[c] for c in range(len(means))])
    return own


def balanced(x: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each row: at most ceil(1.3 n / k) rows each, rows with the most to lose chosen first."""
    x = guard(x)
    k = max(1, min(k, len(x)))
    cap, means, own = int(np.ceil(SLACK * len(x) / k)), x[farthest_first(x, k, 0)], None
    for _ in range(ROUNDS):
        new = with_capacity(l2(x, means), cap, largest_first=True)
        if own is not None and (new == own).all():
            break
        own = new
        means = np.array([x[own == c].mean(axis=0) if (own == c).any() else means[c] for c in range(k)])
    return own
