"""Second-order boosted trees on quantised features, for one training set or many growing ones at once.

Features become bins once, at quantiles of all training rows. Every level of a tree is one pass: each task adds its
rows' gradients and Hessians of the log loss to histograms (model, node, feature, bin), Spark sums them (small ones the
driver), and the driver, which never sees a row, picks each node's split from them. Sums are of whole numbers (gradients times
2^32), so neither the order of the rows nor their partitions change a model; which rows a tree samples is
decided by a hash of their key.

A walk-forward backtest trains a model per test block on all earlier days. These models share the passes: a row
adds to the histograms of every model that trains on it, so a tree level of all windows is one job.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.operators.trees import Tree
from tapewise.sources import staging

#: Gradients are summed as whole multiples of this.
UNIT = 2.0 ** -32
#: Trees after which the rows' margins are written anew; in between the newer trees are applied in every pass.
KEPT_TREES = 25
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Settings:
    """Those of the surveyed application; ``alpha`` and ``lam`` are the L1 and L2 penalties of leaves, ``gamma`` the least gain of a split.

    ``rows`` and ``columns`` are the shares sampled for each tree, ``weight`` the least Hessian sum of a leaf. The first
    prediction is 0.5.
    """

    trees: int = 300
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    weight: float = 5.0
    gamma: float = 0.1
    alpha: float = 0.1
    lam: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Grower:
    """A tree while it grows: splits by bin, one entry per node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    g: list[float] = field(default_factory=lambda: [0.0])
    h: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])  # nodes of the level to be split

    def split(self, node: int, feature: int, at: int, gain: float, sums: tuple[float, float, float, float]) -> None:
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        for side, (g, h) in ((self.left, sums[:2]), (self.right, sums[2:])):
            side[node] = len(self.feature)
            for column, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.g, g), (self.h, h), (self.gain, 0.0)):
                column.append(value)

    def pruned(self, gamma: float) -> None:
        """Takes back splits into two leaves that gain less than ``gamma``, from the bottom up."""
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0 and self.gain[node] < gamma and self.feature[self.left[node]] < 0 and self.feature[self.right[node]] < 0:
                self.feature[node] = self.left[node] = self.right[node] = -1

    def done(self, cuts: list[np.ndarray], settings: Settings) -> Tree:
        """Only the nodes still reached, with leaf values."""
        at, number = [0], {0: 0}
        for node in at:
            if self.feature[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    number[child] = len(at)
                    at.append(child)
        inner = [self.feature[n] >= 0 for n in at]
        values = [0.0 if i else -settings.rate * _soft(self.g[n], settings.alpha) / (self.h[n] + settings.lam) for n, i in zip(at, inner)]
        return Tree(np.array([self.feature[n] for n in at]), np.array([cuts[self.feature[n]][self.bin[n]] if i else 0.0 for n, i in zip(at, inner)]),
                    np.array([number[self.left[n]] if i else -1 for n, i in zip(at, inner)]),
                    np.array([number[self.right[n]] if i else -1 for n, i in zip(at, inner)]), np.array(values), np.array([self.h[n] for n in at]))


def _soft(g: float | np.ndarray, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def sampled_columns(settings: Settings, tree: int, features: int) -> np.ndarray:
    """Places of the columns that a tree may split, among as many as its model has."""
    return np.sort(np.random.default_rng([settings.seed, tree]).choice(features, max(1, round(settings.columns * features)), replace=False))


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Quantiles of each feature between bins; ``bins`` - 1 numbers a feature at most."""
    shares = [k / bins for k in range(1, bins)]
    known = [F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 10_000) for f in features]
    return [np.unique(np.array(q if q is not None else [0.0], float)) for q in rows.agg(*known).first()]


def _packed(frames: Iterator[pd.DataFrame], features: list[str], cuts: list[np.ndarray], edges: np.ndarray) -> Iterator[pd.DataFrame]:
    """Blocks of rows: bins (a byte each), labels, hashes, the first model that trains on each row (ascending), and margins of all models."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for frame in frames:
        for start in range(0, len(frame), BLOCK_ROWS):
            part = frame.iloc[start:start + BLOCK_ROWS]
            first = np.searchsorted(edges, part["day"].to_numpy(float), side="right").astype(np.int32)
            part, first = part.iloc[np.argsort(first, kind="stable")], np.sort(first)
            x = np.stack([np.searchsorted(c, part[f].to_numpy(float)) for f, c in zip(features, cuts)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"id": [number], "x": [x.tobytes()], "y": [part["label"].to_numpy(np.float64).tobytes()],
                                "hash": [part["_hash"].to_numpy(np.int64).tobytes()], "first": [first.tobytes()],
                                "margin": [np.zeros((len(edges), len(part))).tobytes()]})
            number += 1


def _leaf(x: np.ndarray, tree: Grower) -> np.ndarray:
    """The node of each row of bins."""
    feature, cut, left, right = (np.array(c) for c in (tree.feature, tree.bin, tree.left, tree.right))
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])


@dataclass
class Passed:
    """What a pass knows of the trees so far: how many are in the written margins, and the newer ones of each model with their leaf values."""

    fit: str
    written: int
    newer: list[list[tuple[Grower, np.ndarray]]]


#: Margins of blocks that a worker has seen, by fit and block, with the number of trees in them; at most KEPT_BYTES.
_seen: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
KEPT_BYTES = 256 << 20


def _blocks(batches: Iterator[pa.RecordBatch], features: int, so_far: Passed):
    """The row, x, y, hashes, margins (a row per model), and how many rows each model trains on, of each block.

    A worker that saw the block before applies only the trees that came since; any other starts from the written margins.
    """
    models = len(so_far.newer)
    for batch in batches:
        for row in batch.to_pylist():
            x, first = np.frombuffer(row["x"], np.uint8).reshape(-1, features), np.frombuffer(row["first"], np.int32)
            ends = np.searchsorted(first, np.arange(models), side="right")
            applied, margins = _seen.get((so_far.fit, row["id"]), (-1, None))
            if applied < so_far.written:
                applied, margins = so_far.written, np.frombuffer(row["margin"]).reshape(models, -1).copy()
            for m, trees in enumerate(so_far.newer):
                for tree, values in trees[applied - so_far.written:]:
                    margins[m, :ends[m]] += values[_leaf(x[:ends[m]], tree)]
            if sum(kept.nbytes for _, kept in _seen.values()) + margins.nbytes > KEPT_BYTES:
                _seen.clear()
            _seen[so_far.fit, row["id"]] = so_far.written + len(so_far.newer[0]), margins
            yield row, x, np.frombuffer(row["y"]), np.frombuffer(row["hash"], np.int64).view(np.uint64), margins, ends


def _histograms(batches: Iterator[pa.RecordBatch], features: int, settings: Settings, number: int, columns: list[np.ndarray], so_far: Passed,
                growing: list[Grower]) -> Iterator[pa.RecordBatch]:
    """The sums of a task, a row per model and open node with rows: their number, and g and h of all features' bins as bytes."""
    slots, bins = max(len(t.open) for t in growing), settings.bins
    size = slots * features * bins
    total = np.zeros((2, len(growing), size), np.int64)
    for _, x, y, key, margins, ends in _blocks(batches, features, so_far):
        sample = np.flatnonzero(mixed(key, settings.seed + 1000 * number) < settings.rows)
        for m, (tree, end) in enumerate(zip(growing, ends)):
            rows = sample[:np.searchsorted(sample, end)]
            if not tree.open or not len(rows):
                continue
            slot = np.full(len(tree.feature), -1)
            slot[tree.open] = np.arange(len(tree.open))
            here = slot[_leaf(x[rows], tree)]
            rows, here = rows[here >= 0], here[here >= 0]
            p = 1.0 / (1.0 + np.exp(-margins[m, rows]))
            sums = [np.rint(part / UNIT) for part in (p - y[rows], p * (1.0 - p))]
            for c in columns[m]:
                cell = (here * features + c) * bins + x[rows, c]
                for k in range(2):
                    total[k, m] += np.bincount(cell, sums[k], size).astype(np.int64)
    nodes = total.reshape(2, len(growing) * slots, features * bins).transpose(1, 0, 2)
    found = np.flatnonzero(nodes.any(axis=(1, 2)))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([nodes[k].tobytes() for k in found], pa.binary())], names=["node", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node: the sums of all tasks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for node, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(sums, np.int64)
            total[node] = total[node] + part if node in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["node", "sums"])


def _rewritten(batches: Iterator[pa.RecordBatch], features: int, so_far: Passed) -> Iterator[pa.RecordBatch]:
    for row, *_, margins, _ in _blocks(batches, features, so_far):
        yield pa.RecordBatch.from_pylist([row | {"margin": margins.tobytes()}], pa.schema(_KINDS))


_BLOCK = "id long, x binary, y binary, hash binary, first binary, margin binary"
_KINDS = [("id", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("hash", pa.binary()), ("first", pa.binary()), ("margin", pa.binary())]


def best_split(g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], settings: Settings) -> tuple[float, int, int, tuple] | None:
    """The split of a node with the largest gain, from its histograms (feature, bin): gain, feature, bin, sums of both sides.

    Of equal gains that of the first feature and bin. Both sides need a Hessian sum of ``weight``.
    """
    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    all_g, all_h = gl[:, -1:], hl[:, -1:]
    gr, hr = all_g - gl, all_h - hl

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _soft(a, settings.alpha) ** 2 / (b + settings.lam)

    gain = score(gl, hl) + score(gr, hr) - score(all_g, all_h)
    allowed = (hl >= settings.weight) & (hr >= settings.weight) & (np.arange(g.shape[1])[None, :] < np.array([len(c) for c in cuts])[:, None])
    gain = np.where(allowed, gain, -np.inf)
    f, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[f, at] <= 1e-9:
        return None
    return float(gain[f, at]), int(f), int(at), (float(gl[f, at]), float(hl[f, at]), float(gr[f, at]), float(hr[f, at]))


def grow_level(growing: list[Grower], sums: np.ndarray, columns: list[np.ndarray], cuts: list[np.ndarray], settings: Settings, last: bool) -> None:
    """Splits the open nodes of each tree by ``sums`` (2, model, open node, feature, bin) of the ``columns`` sampled for its model; on the ``last`` level nothing stays open."""
    for m, tree in enumerate(growing):
        after = []
        for slot, node in enumerate(tree.open):
            g, h = sums[0, m, slot][columns[m]] * UNIT, sums[1, m, slot][columns[m]] * UNIT
            if node == 0:
                tree.g[0], tree.h[0] = float(g[0].sum()), float(h[0].sum())
            found = best_split(g, h, [cuts[c] for c in columns[m]], settings)
            if found is not None:
                gain, f, at, sides = found
                tree.split(node, int(columns[m][f]), at, gain, sides)
                after += [tree.left[node], tree.right[node]]
        tree.open = [] if last else after


@dataclass
class Boosted:
    """A fitted sum of trees; its value is the log-odds."""

    features: list[str]
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree.predict(x)
        return total


class _Passes:
    """The many small jobs over the written blocks, in a session of their own without adaptive re-planning.

    Each task hands on at most one row per node; so many tasks add them up that none gets more than about BYTES. Sums that are
    less than DIRECT together are added up by the driver instead, which saves each job its exchange and second stage.
    """

    BYTES = 64 << 20
    DIRECT = 8 << 20

    def __init__(self, blocks: DataFrame):
        self.home, self.spark = blocks.sparkSession, blocks.sparkSession.newSession()
        self.most = int(self.home.conf.get("spark.sql.shuffle.partitions"))
        self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        self.write(blocks)

    def write(self, blocks: DataFrame) -> None:
        path = staging.new_path(self.home, "boost-blocks")
        blocks.write.parquet(path)
        self.blocks = self.spark.read.schema(_BLOCK).parquet(path)
        self.tasks = self.blocks.rdd.getNumPartitions()

    def sums(self, task, nodes: int, cells: int) -> np.ndarray:
        size = self.tasks * nodes * cells * 16  # at most, of all tasks' sums
        kinds = "node long, sums binary"
        found = self.blocks.mapInArrow(task, kinds)
        if size > self.DIRECT:
            parts = min(self.most, max(1, size // self.BYTES))
            found = found.repartition(parts, "node").mapInArrow(_added, kinds)
        found = found.toArrow()
        out = np.zeros((nodes, 2, cells), np.int64)
        for node, sums in zip(found.column("node").to_pylist(), found.column("sums").to_pylist()):
            out[node] += np.frombuffer(sums, np.int64).reshape(2, cells)
        return out.transpose(1, 0, 2).astype(float)


def fit_boosted(rows: DataFrame, features: list[str], edges: list[float] | None = None, key: tuple[str, ...] = ("ticker", "date"),
                settings: Settings = Settings(), subsets: list[list[str]] | None = None) -> list[Boosted]:
    """One model per edge, trained on the rows whose ``day`` is below it; without edges one model of all rows.

    With ``subsets`` one model per subset of the features, all on all rows, in the same passes.

    ``rows`` has the features, ``label`` and for edges ``day``. Null and NaN features are larger than every cut. Bins
    are quantiles of the rows of the smallest edge, which all models train on, so none knows of later rows. Without
    rows of a model its trees are single leaves of value 0.
    """
    edge = np.array(edges if edges is not None else [math.inf] * len(subsets or [features]), float)
    own = [[features.index(f) for f in subset] for subset in subsets] if subsets else [list(range(len(features)))] * len(edge)
    day = F.col("day").cast("double") if edges is not None else F.lit(0.0)
    used = rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(math.nan)).alias(f) for f in features], F.col("label").cast("double").alias("label"),
                       day.alias("day"), F.xxhash64(*key).alias("_hash")).filter(F.col("day") < float(edge.max()))
    cuts = cut_points(used.filter(F.col("day") < float(edge.min())), features, settings.bins)
    passes = _Passes(used.mapInPandas(partial(_packed, features=features, cuts=cuts, edges=edge), _BLOCK))
    d, models = len(features), len(edge)
    fitted: list[list[Tree]] = [[] for _ in range(models)]
    so_far = Passed(uuid.uuid4().hex, 0, [[] for _ in range(models)])
    for number in range(settings.trees):
        growing, columns = [Grower() for _ in range(models)], [np.array(mine)[sampled_columns(settings, number, len(mine))] for mine in own]
        for level in range(settings.depth):
            slots = max(len(t.open) for t in growing)
            if not slots:
                break
            task = partial(_histograms, features=d, settings=settings, number=number, columns=columns, so_far=so_far, growing=growing)
            sums = passes.sums(task, models * slots, d * settings.bins).reshape(2, models, slots, d, settings.bins)
            grow_level(growing, sums, columns, cuts, settings, level == settings.depth - 1)
        for m, tree in enumerate(growing):
            tree.pruned(settings.gamma)
            fitted[m].append(tree.done(cuts, settings))
            so_far.newer[m].append((tree, _values(tree, settings)))
        if (number + 1) % KEPT_TREES == 0 and number + 1 < settings.trees:
            passes.write(passes.blocks.mapInArrow(partial(_rewritten, features=d, so_far=so_far), _BLOCK))
            so_far = Passed(so_far.fit, number + 1, [[] for _ in range(models)])
    return [Boosted(features, trees) for trees in fitted]


def _values(tree: Grower, settings: Settings) -> np.ndarray:
    leaf = np.array(tree.feature) < 0
    return np.where(leaf, -settings.rate * _soft(np.array(tree.g), settings.alpha) / (np.array(tree.h) + settings.lam), 0.0)
