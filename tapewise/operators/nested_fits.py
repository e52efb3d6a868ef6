"""Many logistic fits on growing training sets of one panel, in a few passes over the panel.

A walk-forward backtest fits one model per test block, each on all rows before the block. Fitting them
one by one reads the early rows once per block and iteration. Here one Newton pass adds every row to the
gradient and Hessian of all models that train on it: tasks sum over their rows with matrix products and
return one small block per model, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class NestedLogistic:
    """Model m was fitted on the ``train_size[m]`` rows with day < cuts[m]."""

    features: list[str]
    cuts: list[int]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # one row per model, intercept last
    train_size: list[int]

    def raw_weights(self) -> np.ndarray:
        """Weights on raw features, intercept last; one row per model."""
        scaled = self.weights[:, :-1] / self.deviation
        return np.hstack([scaled, (self.weights[:, -1] - (scaled * self.mean).sum(1))[:, None]])

    def table(self, like: DataFrame) -> DataFrame:
        """(model, train_size, w) with one row per model."""
        rows = [(m, int(n), w.tolist()) for m, (n, w) in enumerate(zip(self.train_size, self.raw_weights()))]
        return like.sparkSession.createDataFrame(rows, "model int, train_size long, w array<double>")

    def margin(self, w: str = "w") -> Column:
        """Log-odds of a row joined with its model's weights."""
        x = F.array(*[F.col(f).cast("double") for f in self.features], F.lit(1.0))
        return F.aggregate(F.zip_with(x, F.col(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _total(rows: DataFrame, models: int, width: int, add: Callable[[pd.DataFrame, np.ndarray], None]) -> np.ndarray:
    """Sum over all rows of a (models x width) block that ``add`` accumulates per Arrow batch."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = np.zeros((models, width))
        for batch in batches:
            if len(batch):
                add(batch, block)
        yield pd.DataFrame({"model": np.arange(models, dtype="int32"), "part": list(block)})

    partial = rows.mapInPandas(task, "model int, part array<double>")  # one row per task and model
    cells = partial.select("model", F.posexplode("part").alias("cell", "v"))
    out = np.zeros((models, width))
    for row in cells.groupBy("model", "cell").agg(F.sum("v").alias("v")).collect():  # models x width numbers
        out[row["model"], row["cell"]] = row["v"]
    return out


def _newton(used: DataFrame, features: list[str], models: int, parts, c: float, steps: int, tolerance: float) -> tuple[np.ndarray, ...]:
    """Mean, deviation, weights and number of rows of each model; ``parts(batch)`` gives x, and (rows, labels) of each model."""
    d = len(features)
    # Moments about the mean of all rows, so that a large mean takes no digits from a small deviation.
    centre = np.array([v if v is not None else 0.0 for v in used.agg(*[F.avg(f) for f in features]).first()], dtype=float)

    def moments(batch: pd.DataFrame, block: np.ndarray) -> None:
        x, own = parts(batch)
        x = x - centre
        for m, (rows, _) in enumerate(own):
            block[m, 0] += len(x[rows])
            block[m, 1:] += np.hstack([x[rows].sum(0), (x[rows] ** 2).sum(0)])

    total = _total(used, models, 1 + 2 * d, moments)
    n = np.maximum(total[:, :1], 1.0)
    shift = total[:, 1:1 + d] / n
    mean, deviation = centre + shift, np.sqrt(np.maximum(total[:, 1 + d:] / n - shift * shift, 0.0))
    deviation[deviation == 0] = 1.0
    weights = np.zeros((models, d + 1))
    ridge = np.r_[np.ones(d), 0.0] / c

    for _ in range(steps):
        current = weights.copy()

        def newton(batch: pd.DataFrame, block: np.ndarray, current: np.ndarray = current) -> None:
            x, own = parts(batch)
            for m, (rows, y) in enumerate(own):
                a = np.hstack([(x[rows] - mean[m]) / deviation[m], np.ones((len(y), 1))])
                p = 1.0 / (1.0 + np.exp(-np.clip(a @ current[m], -500, 500)))
                block[m, :d + 1] += a.T @ (p - y)
                block[m, d + 1:] += ((a * (p * (1 - p))[:, None]).T @ a).ravel()

        total = _total(used, models, (d + 1) + (d + 1) ** 2, newton)
        moved = 0.0
        for m in range(models):
            gradient = total[m, :d + 1] + ridge * current[m]
            hessian = total[m, d + 1:].reshape(d + 1, d + 1) + np.diag(ridge) + 1e-12 * np.eye(d + 1)
            move = np.linalg.solve(hessian, gradient)
            weights[m] -= move
            moved = max(moved, float(np.abs(move).max()))
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"not converged after {steps} steps: the last one moved a weight by {moved:.3g}")
    return mean, deviation, weights, n[:, 0]


def fit_nested(rows: DataFrame, features: list[str], cuts: list[int], c: float = 1.0, steps: int = 50,
               tolerance: float = 1e-8) -> NestedLogistic:
    """L2 logistic models (1/2|w|^2 + c*sum(loss), population-standardised features) for all ``cuts``.

    ``rows`` has ``day``, ``label`` and the features; it is read once per Newton step, so cache it. A fit that
    has not converged after ``steps`` raises.
    """
    edges, k = np.array(cuts), len(cuts)

    def parts(batch: pd.DataFrame):
        """Rows sorted by the first model that trains on them: each model has the first ones."""
        first = np.searchsorted(edges, batch["day"].to_numpy(), side="right")
        order = np.argsort(first, kind="stable")
        ends = np.searchsorted(first[order], np.arange(k), side="right")
        y = batch["label"].to_numpy(float)[order]
        return batch[features].to_numpy(float)[order], [(slice(0, end), y[:end]) for end in ends]

    mean, deviation, weights, n = _newton(rows.select("day", "label", *features), features, k, parts, c, steps, tolerance)
    return NestedLogistic(features, list(cuts), mean, deviation, weights, [int(x) for x in n])


def fit_labels(rows: DataFrame, features: list[str], labels: list[str], c: float = 1.0, steps: int = 50, tolerance: float = 1e-8) -> NestedLogistic:
    """One such model per label column, trained on the rows where it is not null; all share their passes over ``rows``."""
    def parts(batch: pd.DataFrame):
        known = [np.flatnonzero(batch[label].notna().to_numpy()) for label in labels]
        return batch[features].to_numpy(float), [(at, batch[label].to_numpy(float)[at]) for label, at in zip(labels, known)]

    mean, deviation, weights, n = _newton(rows.select(*labels, *features), features, len(labels), parts, c, steps, tolerance)
    return NestedLogistic(features, [], mean, deviation, weights, [int(x) for x in n])
