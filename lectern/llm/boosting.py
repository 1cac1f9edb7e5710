"""Gradient-boosted trees for two classes on small samples, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Node = tuple[int, float, int, int, float]  # feature (-1 in a leaf), threshold, left, right, value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class BoostedTrees:
    """Sum of regression trees on the log-odds, then a straight line fitted on a holdout."""

    start: float = 0.0
    trees: list[list[Node]] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration."""
        out = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            feature, threshold, left, right, value = (np.array(c) for c in zip(*tree))
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                n = at[rows]
                low = x[rows, feature[n]] <= threshold[n]
                at[rows] = np.where(low, left[n], right[n])
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of class 1."""
        return _sigmoid(self.slope * self.margin(x) + self.offset)

    def calibrate(self, x: np.ndarray, y: np.ndarray, prior: float = 1.0, steps: int = 100) -> None:
        """Fit the straight line on a holdout by Newton steps; ``prior`` draws it towards the identity."""
        m = np.c_[self.margin(x), np.ones(len(x))]
        w = np.array([1.0, 0.0])
        for _ in range(steps):
            p = _sigmoid(m @ w)
            gradient = m.T @ (p - y) + prior * (w - [1.0, 0.0])
            hessian = (m * (p * (1 - p))[:, None]).T @ m + prior * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 0.5 / max(1e-12, np.abs(step).max()))
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = max(1e-3, w[0]), w[1]


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8
) -> BoostedTrees:
    """Trees on binned features by second-order gain; with one class only, a constant."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = BoostedTrees(float(np.log(share / (1 - share))))
    if len(y) < 2 * least or len(np.unique(y)) < 2:
        return model
    inner = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [
        np.unique(np.r_[np.quantile(c, inner), c.min() + inner * (c.max() - c.min())]) for c in x.T
    ]  # by rank and by value: a gap between two dense values gets edges too
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = p - y, p * (1 - p) + 1e-9
        tree: list[Node] = []
        _grow(tree, np.arange(len(y)), binned, edges, g, h, depth, rate, least)
        model.trees.append(tree)
        margin += BoostedTrees(0.0, [tree]).margin(x)
    return model


def _grow(tree, rows, binned, edges, g, h, depth, rate, least) -> int:
    number = len(tree)
    tree.append((-1, 0.0, 0, 0, float(-rate * g[rows].sum() / (h[rows].sum() + 1.0))))
    if depth == 0 or len(rows) < 2 * least:
        return number
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0)
    for j, e in enumerate(edges):
        if not len(e):
            continue
        n = len(e) + 1
        sg, sh = (np.bincount(binned[rows, j], weights=v[rows], minlength=n).cumsum()[:-1] for v in (g, h))
        count = np.bincount(binned[rows, j], minlength=n).cumsum()[:-1]
        gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
        gain[(count < least) | (len(rows) - count < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, k)
    if best[1] < 0:
        return number
    _, j, k = best
    low = binned[rows, j] <= k
    left = _grow(tree, rows[low], binned, edges, g, h, depth - 1, rate, least)
    right = _grow(tree, rows[~low], binned, edges, g, h, depth - 1, rate, least)
    tree[number] = (j, float(edges[j][k]), left, right, 0.0)
    return number
