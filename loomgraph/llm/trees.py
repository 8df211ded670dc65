"""Small decision trees over a bounded sample: gradient boosting, random forests, calibration, and their Spark form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature, threshold, below, from the threshold on), or a leaf's value.
Tree = tuple | float


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, penalty: float, pick, cuts: int) -> Tree:
    """A tree for the second-order loss of gradients ``g`` and curvatures ``h``."""
    total_g, total_h = g.sum(), h.sum()
    leaf = float(-total_g / (total_h + penalty))
    if depth == 0 or total_h < 2 * least:
        return leaf
    best = (1e-9, -1, 0.0)
    for f in pick(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        edges = (values[1:] + values[:-1]) / 2
        if len(edges) > cuts:
            edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
        bins = np.searchsorted(edges, x[:, f], "right")
        gl = np.cumsum(np.bincount(bins, g, len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(bins, h, len(edges) + 1))[:-1]
        gain = gl**2 / (hl + penalty) + (total_g - gl) ** 2 / (total_h - hl + penalty) - total_g**2 / (total_h + penalty)
        gain[(hl < least) | (total_h - hl < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(edges[k]))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] < best[2]
    return (best[1], best[2], *(_grow(x[m], g[m], h[m], depth - 1, least, penalty, pick, cuts) for m in (low, ~low)))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    out = np.empty(len(x))
    low = x[:, tree[0]] < tree[1]
    for m, below in ((low, tree[2]), (~low, tree[3])):
        if m.any():
            out[m] = _value(below, x[m])
    return out


def _column(tree: Tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(round(tree, 6))
    return F.when(features[tree[0]] < tree[1], _column(tree[2], features)).otherwise(_column(tree[3], features))


@dataclass(frozen=True)
class Ensemble:
    """``scale * mean or sum of the trees + base``: a log-odds for boosting, a share of votes for a forest."""

    trees: tuple[Tree, ...]
    base: float
    scale: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.scale * sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        out = F.lit(self.base)
        for t in self.trees:
            out = out + self.scale * _column(t, features)
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: float = 1.0, penalty: float = 1.0, cuts: int = 32) -> Ensemble:
    """Boosted trees for the logistic loss; the threshold is even odds until calibrated."""
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    raw, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        t = _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), depth, least, penalty, range, cuts)
        out.append(t)
        raw = raw + rate * _value(t, x)
    return Ensemble(tuple(out), base, rate, 0.0)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 3, cuts: int = 32) -> Ensemble:
    """Trees on bootstrap samples, each split among a random half of the features; a leaf votes with its share of findings."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], -y[rows].astype(float), np.ones(len(y)), depth, 2, 1e-9, lambda n: sorted(rng.choice(n, max(1, n // 2), replace=False)), cuts))
    return Ensemble(tuple(out), 0.0, 1 / trees, 0.5)


def calibrated(model: Ensemble, x: np.ndarray, y: np.ndarray, precision: float) -> Ensemble:
    """The lowest threshold on rows kept back from which precision holds (midway to the next row below)."""
    raw = model.raw(x)
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    fine = np.flatnonzero((hits / np.arange(1, len(y) + 1) >= precision) & np.append(raw[order][1:] < raw[order][:-1], True))
    if not len(fine):
        return Ensemble(model.trees, model.base, model.scale, float("inf"))
    k = int(fine[-1])
    below = raw[order][k + 1] if k + 1 < len(y) else raw[order][k] - 1
    return Ensemble(model.trees, model.base, model.scale, float((raw[order][k] + below) / 2))
