"""Block bootstrap and null distributions; a draw depends on (seed, draw), never on partitions."""

from __future__ import annotations

import numpy as np


def auc(y, p) -> float:
    """Rank statistic with mean ranks; NaN with one class."""
    keep = ~(np.isnan(y) | np.isnan(p))
    y, p = y[keep], p[keep]
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return float("nan")
    values, inverse, count = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def brier(y, p) -> float:
    keep = ~(np.isnan(y) | np.isnan(p))
    return float(((p[keep] - y[keep]) ** 2).mean()) if keep.any() else float("nan")


METRICS = {"auc": auc, "brier": brier}


def runs(y) -> list[np.ndarray]:
    """Index blocks of equal labels."""
    cuts = np.flatnonzero(np.diff(y) != 0) + 1
    return np.split(np.arange(len(y)), cuts)


def resample(blocks: list[np.ndarray], seed: int, draw: int) -> np.ndarray:
    """Rows of as many blocks as there are, drawn with replacement."""
    pick = np.random.default_rng([seed, draw]).integers(0, len(blocks), len(blocks))
    return np.concatenate([blocks[i] for i in pick])


def ic(x, y) -> float:
    keep = ~(np.isnan(x) | np.isnan(y))
    if keep.sum() < 3 or x[keep].std() == 0 or y[keep].std() == 0:
        return float("nan")
    return float(np.corrcoef(x[keep], y[keep])[0, 1])
