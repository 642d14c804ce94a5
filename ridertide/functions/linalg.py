"""Small dense solve on sums that Spark has already aggregated (at most eight models)."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def nonnegative_blend(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Non-negative least squares from Gram sums, scaled to sum to one.

    Every support set is solved (at most 2^8 for eight models) and the feasible one with the least squared error is
    kept. With no usable solution all models weigh the same.
    """
    k = len(moment)
    best, best_cost = np.zeros(k), 0.0
    for size in range(1, k + 1):
        for active in combinations(range(k), size):
            part = list(active)
            try:
                w = np.linalg.solve(gram[np.ix_(part, part)], moment[part])
            except np.linalg.LinAlgError:
                continue
            if not np.isfinite(w).all() or (w < 0).any():
                continue
            cost = w @ gram[np.ix_(part, part)] @ w - 2 * w @ moment[part]
            if cost < best_cost - 1e-12 * max(1.0, abs(best_cost)):
                best, best_cost = np.zeros(k), cost
                best[part] = w
    total = best.sum()
    if not np.isfinite(total) or total <= 0:
        return np.full(k, 1.0 / k)
    return best / total
