"""Gradient-boosted trees on small matrices, and their calibration."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from textloom.llm.labelled import sigmoid

ROUNDS, DEPTH, RATE, RIDGE, BINS = 40, 3, 0.2, 1.0, 32


class Trees(NamedTuple):
    """Complete trees of one depth: a node sends a row right where its feature is above the cut; leaves are in order."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows."""
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Newton steps on the logistic loss: each tree splits on the best cut of all features' histograms, level by level."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    width, nodes = BINS, 2**DEPTH - 1
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * x.shape[1] + np.arange(x.shape[1])) * width + bins
            total = many * x.shape[1] * width
            shape = (many, x.shape[1], width)
            left_g = np.bincount(cell.ravel(), np.repeat(g, x.shape[1]), total).reshape(shape).cumsum(2)
            left_h = np.bincount(cell.ravel(), np.repeat(h, x.shape[1]), total).reshape(shape).cumsum(2)
            all_g, all_h = left_g[..., -1:], left_h[..., -1:]
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            best = gain.reshape(many, -1).argmax(1)
            for i, b in enumerate(best):
                f, at = divmod(int(b), width)
                if at < len(cuts[f]) and gain[i].ravel()[b] > 1e-9:
                    feature[first + i], cut[first + i] = f, cuts[f][at]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        own = node - nodes
        leaf = RATE * np.bincount(own, g, nodes + 1) / (np.bincount(own, h, nodes + 1) + RIDGE)
        score += leaf[own]
        trees.append((feature, cut, leaf))
    return Trees(start, *(np.array(t) for t in zip(*trees, strict=True)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest scores of the steps of the rising curve nearest to y, and the steps' shares, one doubtful row added to each."""
    order = np.argsort(score, kind="stable")
    steps: list[list[float]] = []  # lowest score, rows, positives
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if steps and steps[-1][0] == s:
            steps[-1][1] += 1
            steps[-1][2] += v
        else:
            steps.append([s, 1, v])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            low, n, k = steps.pop()
            steps[-1][1] += n
            steps[-1][2] += k
    return np.array([s[0] for s in steps]), np.array([s[2] / (s[1] + 1) for s in steps])


def threshold(score: np.ndarray, y: np.ndarray, share: float) -> float:
    """The lowest score from which on the calibrated share of positives is ``share`` or more; infinite where it never is."""
    low, shares = isotonic(score, y)
    good = np.flatnonzero(shares >= share)
    return float(low[good[0]]) if len(good) else np.inf
