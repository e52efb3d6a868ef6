"""Decision trees as small arrays, and exact Shapley values of their predictions.

The value of a feature set S at a row is what a tree predicts when only the features in S are known: at a split of
another feature both sides count by the training rows that went there. Along the path to one leaf that is a
product over the path's features: 1 or 0 for a known feature whose splits the row passes or not, the share of
rows that pass them for an unknown one. So what a leaf adds to the Shapley value of each feature on its path
depends on which of them the row passes only: one of 2^depth patterns, worked out once per leaf by summing over the
subsets of the path's features.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays, the root first. A row goes left where its feature is at most the threshold, else (or if NaN) right."""

    feature: np.ndarray  # -1 for a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # training rows (or their weight) in the node

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])

    def expected(self) -> float:
        """The value of the empty feature set: leaves by their shares of the rows."""
        return float(sum(p.value * np.prod(p.share) for p in self.paths()))

    def paths(self) -> list[Path]:
        """One path per leaf; the splits of one feature along it are one range."""
        out: list[Path] = []

        def walk(node: int, ranges: dict[int, tuple[float, float, float]]) -> None:
            f = int(self.feature[node])
            if f < 0:
                features = list(ranges)
                low, high, share = (np.array([ranges[g][k] for g in features]) for k in range(3))
                out.append(Path(np.array(features, np.int64), low, high, share, float(self.value[node])))
                return
            for child, below in ((int(self.left[node]), True), (int(self.right[node]), False)):
                low, high, share = ranges.get(f, (-np.inf, np.inf, 1.0))
                part = float(self.cover[child] / self.cover[node]) if self.cover[node] > 0 else 0.5
                cut = float(self.threshold[node])
                walk(child, {**ranges, f: (low, min(high, cut), share * part) if below else (max(low, cut), high, share * part)})

        walk(0, {})
        return out


@dataclass(frozen=True)
class Path:
    features: np.ndarray
    low: np.ndarray  # a row passes where low < x <= high; splits to the right only also pass NaN
    high: np.ndarray
    share: np.ndarray  # of the rows, what the feature's splits let through
    value: float

    def table(self) -> np.ndarray:
        """What the leaf adds to each feature's Shapley value (rows), by which features pass (bit k: the k-th does)."""
        m = len(self.features)
        passes = (np.arange(1 << m)[None, :] >> np.arange(m)[:, None] & 1).astype(float)
        out = np.zeros((m, 1 << m))
        for k in range(m):
            others = [g for g in range(m) if g != k]
            for size in range(m):
                weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                for known in combinations(others, size):
                    term = np.full(1 << m, weight * self.value)
                    for g in others:
                        term *= passes[g] if g in known else self.share[g]
                    out[k] += term * (passes[k] - self.share[k])
        return out


class Shapley:
    """Shapley values of a sum of trees."""

    def __init__(self, trees: list[Tree], scales: list[float], features: int):
        self.features = features
        self.base = float(sum(s * t.expected() for t, s in zip(trees, scales)))
        self.paths = [(p, scale * p.table()) for t, scale in zip(trees, scales) for p in t.paths() if len(p.features)]

    def values(self, x: np.ndarray) -> np.ndarray:
        """A row of values per row of ``x``; with ``base`` they sum to the prediction."""
        out = np.zeros((self.features, len(x)))
        columns = np.ascontiguousarray(x.T)
        known: dict[tuple[int, float], np.ndarray] = {}

        def at_most(f: int, cut: float) -> np.ndarray:
            if (f, cut) not in known:
                known[f, cut] = columns[f] <= cut
            return known[f, cut]

        for path, table in self.paths:
            pattern = np.zeros(len(x), np.int64)
            for k, (f, low, high) in enumerate(zip(path.features.tolist(), path.low.tolist(), path.high.tolist())):
                passes = at_most(f, high) if high < np.inf else np.ones(len(x), bool)
                if low > -np.inf:
                    passes = passes & ~at_most(f, low)
                pattern |= passes.astype(np.int64) << k
            for k, f in enumerate(path.features.tolist()):
                out[f] += table[k][pattern]
        return out.T


def of_spark(tree) -> Tree:
    """A tree of a fitted Spark model."""
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, node.prediction(), node.impurityStats().count()])
        if node.subtreeDepth():
            split = node.split()
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    add(tree.rootNode())
    feature, threshold, left, right, value, cover = map(np.array, zip(*rows))
    return Tree(feature.astype(np.int64), threshold.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float), cover.astype(float))
