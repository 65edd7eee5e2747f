"""Gradient-boosted trees on histograms and isotonic calibration, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Trees of equal depth: node i splits on ``feature[t, i] > cut[t, i]``."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 3.0) -> Trees:
    """Newton boosting of the logistic loss; splits are searched on quantile bins."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    for j in range(d):  # a rare positive value has no quantile of its own
        above = x[x[:, j] > 0, j]
        if len(above):
            cuts[j] = np.unique(np.concatenate([cuts[j], [0.0], np.quantile(above, np.linspace(0, 1, 9)[1:-1])]))
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1)
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    trees = Trees(float(np.log(prior / (1 - prior))), np.zeros((rounds, 2**depth - 1), np.int64), np.full((rounds, 2**depth - 1), np.inf), np.zeros((rounds, 2**depth)))
    margin = np.full(n, trees.bias)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            at, many = 2**level - 1, 2**level
            best, pick = np.full(many, 1e-6), [(0, np.inf)] * many
            for j in range(d):
                key = (node - at) * width + binned[:, j]
                gs = np.bincount(key, g, many * width).reshape(many, width).cumsum(1)
                hs = np.bincount(key, h, many * width).reshape(many, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least * 0.05) | (ht - hs < least * 0.05)] = 0
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(many), k] > best):
                        best[i], pick[i] = gain[i, k[i]], (j, cuts[j][k[i]])
            for i, (j, c) in enumerate(pick):
                trees.feature[t, at + i], trees.cut[t, at + i] = j, c
            node = 2 * node + 1 + (x[np.arange(n), trees.feature[t][node]] > trees.cut[t][node])
        leaf = node - (2**depth - 1)
        gl, hl = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        trees.leaf[t] = rate * gl / (hl + ridge)
        margin += trees.leaf[t][leaf]
    return trees


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) by pool-adjacent-violators; interpolate between them."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of margins
    for m, v in zip(margin[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, m2 = blocks.pop()
            v1, w1, m1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, m1 + m2])
    at = np.array([b[2] / b[1] for b in blocks])
    keep = np.concatenate([[True], np.diff(at) > 1e-9]) if len(at) else np.zeros(0, bool)
    return at[keep], np.array([b[0] for b in blocks])[keep]


def calibrate(margin: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Calibrated probability; a thousandth of the logistic margin keeps it strictly rising."""
    plain = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    flat = np.interp(margin, *knots) if len(knots[0]) else plain
    return np.clip(0.999 * flat + 0.001 * plain, 0.0, 1.0)
