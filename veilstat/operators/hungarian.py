"""Optimal one-to-one assignment of k rows to k columns."""

from __future__ import annotations

import numpy as np


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row at least total cost, by shortest augmenting paths; rows may not outnumber columns."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            open_ = ~used
            open_[0] = False
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = open_[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.where(open_, least, np.inf).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[open_] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
