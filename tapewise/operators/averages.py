"""States of exponential averages at the start of every unit of a panel, exact across gaps of any length.

An average y is an affine map of its earlier value: y -> w*y + (1-w)*x at a row with a value x, unchanged at a
row without one. w is q^d / (q^d + alpha) with q = 1 - alpha and d the rows since the last value, so it is q
where there is no gap. The rows of a unit together are one such map, which the unit's first and last value, the
product of its w and its own average determine. Only the first w depends on earlier units, by the rows since
their last value. So a table with a row per unit holds the maps, and a scan over the units of a ticker (four a
year) composes them into the state before each unit. No halo of rows is needed for the decay.

The values of a unit (at most 92) come as arrays of the unit table; the maps of all units of an Arrow batch are
worked out together, step by step over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How names of columns with whole numbers begin.
WHOLE = ("_at_", "_seen_")
BEFORE = "_before"


@dataclass(frozen=True)
class Carry:
    """The averages whose state is carried: key -> (source, alpha).

    A source is a column's name, or ``gain``, ``loss`` (of the change of close) or ``range`` (true range).
    ``signal`` is an average of the difference of two averages, as (key, fast key, slow key, alpha).
    Where a source needs the close before a row, that before the unit is carried as ``_prev_close``.
    """

    averages: dict[str, tuple[str, float]]
    signal: tuple[str, str, str, float] | None = None
    inputs: list[str] = field(init=False)

    def __post_init__(self):
        needed = {"gain": ["close"], "loss": ["close"], "range": ["close", "high", "low"]}
        names = [c for source, _ in self.averages.values() for c in needed.get(source, [source])]
        object.__setattr__(self, "inputs", list(dict.fromkeys(names)))

    @property
    def sources(self) -> list[str]:
        return list(dict.fromkeys(source for source, _ in self.averages.values()))

    @property
    def columns(self) -> list[str]:
        """A state's value of each average, the position of each source's last value and the number of its values."""
        own = [f"_in_{k}" for k in self.averages] + ([f"_in_{self.signal[0]}"] if self.signal else [])
        changes = bool({"gain", "loss", "range"} & set(self.sources))
        return own + ["_prev_close"] * changes + [f"{kind}_{s}" for s in self.sources for kind in ("_at", "_seen")]

    def summary(self) -> Column:
        """The aggregate of a unit: its rows in order of their dates."""
        known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in self.inputs]
        return F.sort_array(F.collect_list(F.struct("date", *known))).alias("_values")

    def states(self, units: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """``units`` (keys, ``_unit``, ``_start``, ``_values``), together by ticker, with the state before each unit for ``_values``.

        Columns named BEFORE and a state's column give the state before a ticker's first unit; else it starts anew.
        """
        kept = [c for c in units.columns if c != "_values" and not c.startswith(BEFORE)]
        fields = [units.schema[c].simpleString().replace(":", " ", 1) for c in kept]
        fields += [f"{c} {'bigint' if c.startswith(WHOLE) else 'double'}" for c in self.columns]
        rows = units.sortWithinPartitions(*keys, "_unit")
        return rows.mapInArrow(lambda batches: _scan(batches, self, kept, keys), ", ".join(fields))


def _matrices(values: pa.Array, inputs: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """How many rows each unit has, and for each input a row of values per unit; NaN where unknown."""
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten()
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = {}
    for c in inputs:
        out[c] = np.full((len(sizes), max(sizes, default=0)), np.nan)
        out[c][row, at] = flat.field(c).to_numpy(zero_copy_only=False).astype(float)
    return sizes, out


def _series(source: str, data: dict[str, np.ndarray], before: np.ndarray | None) -> np.ndarray:
    if source not in ("gain", "loss", "range"):
        return data[source]
    prev = np.concatenate([before[:, None], data["close"][:, :-1]], axis=1)
    if source == "range":
        high, low = data["high"], data["low"]
        return np.fmax(np.fmax(high - low, np.abs(high - prev)), np.abs(low - prev))
    change = data["close"] - prev
    change = change if source == "gain" else -change
    return np.where(np.isnan(change), np.nan, np.maximum(change, 0.0))


class _Map:
    """The affine maps of one average over many units, worked out row by row."""

    def __init__(self, alpha: float, units: int):
        self.alpha, self.q = alpha, 1.0 - alpha
        self.first = np.full(units, -1)  # row of the first value
        self.x = np.zeros(units)  # that value
        self.y = np.zeros(units)  # the average from there on, of this unit's values alone
        self.v = np.ones(units)  # the weight that the first value's average still has in it
        self.gap = np.zeros(units, np.int64)  # rows since the last value

    def weight(self, rows: np.ndarray) -> np.ndarray:
        old = self.q ** rows
        return np.where(rows == 1, self.q, old / (old + self.alpha))

    def step(self, k: int, x: np.ndarray, live: np.ndarray) -> None:
        known = live & ~np.isnan(x)
        new, more = known & (self.first < 0), known & (self.first >= 0)
        w = self.weight(self.gap + 1)
        self.y = np.where(new, x, np.where(more, w * self.y + (1.0 - w) * x, self.y))
        self.v = np.where(more, w * self.v, self.v)
        self.x, self.first = np.where(new, x, self.x), np.where(new, k, self.first)
        self.gap = np.where(known, 0, self.gap + live)


def _maps(carry: Carry, sizes: np.ndarray, data: dict[str, np.ndarray], before: np.ndarray | None):
    """For each average its maps; for each source its numbers of values; for the signal its sums."""
    series = {s: _series(s, data, before) for s in carry.sources}
    maps = {k: _Map(alpha, len(sizes)) for k, (_, alpha) in carry.averages.items()}
    sums = np.zeros((4, len(sizes)))
    for j in range(max(sizes, default=0)):
        live = j < sizes
        for k, (source, _) in carry.averages.items():
            maps[k].step(j, series[source][:, j], live)
        if carry.signal:
            fast, slow = maps[carry.signal[1]], maps[carry.signal[2]]
            on = fast.first >= 0
            # The difference is (fast.y - slow.y) + fast.v * f - slow.v * s from the first value on, else that of the states.
            parts = np.stack([np.where(on, fast.y - slow.y, 0.0), np.where(on, fast.v, 0.0), np.where(on, slow.v, 0.0), np.where(on, 0.0, 1.0)])
            sums = np.where(live, (1.0 - carry.signal[3]) * sums + carry.signal[3] * parts, sums)
    return maps, {s: np.count_nonzero(~np.isnan(x), axis=1) for s, x in series.items()}, sums


def _scan(batches: Iterator[pa.RecordBatch], carry: Carry, kept: list[str], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Composes the maps of each ticker's units in order and gives the state before each unit."""
    ticker, last_close, state = None, np.nan, {}
    for batch in batches:
        sizes, data = _matrices(batch.column("_values"), carry.inputs)
        names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        same = np.array([n == p for n, p in zip(names, [ticker, *names[:-1]])], bool)
        fresh = {c: 0 if c.startswith("_seen_") else None for c in carry.columns}
        given = {c: batch.column(BEFORE + c).to_pylist() for c in fresh if BEFORE + c in batch.schema.names}
        before = None
        if "close" in data and len(names):
            ends = data["close"][np.arange(len(sizes)), sizes - 1]
            start = np.array(given.get("_prev_close", [None] * len(names)), float)
            before = np.where(same, np.concatenate([[last_close], ends[:-1]]), start)
            last_close = ends[-1]
        maps, counts, sums = _maps(carry, sizes, data, before)
        ticker = names[-1] if names else ticker
        out: dict[str, list] = {c: [] for c in carry.columns}
        starts = batch.column("_start").to_pylist()
        firsts = {k: [m.first.tolist(), m.x.tolist(), m.y.tolist(), m.v.tolist()] for k, m in maps.items()}
        source_of = {s: maps[next(k for k, (own, _) in carry.averages.items() if own == s)] for s in carry.sources}
        lasts = {s: (np.asarray(starts) + sizes - 1 - m.gap).tolist() for s, m in source_of.items()}
        counts = {s: c.tolist() for s, c in counts.items()}
        sums, sizes = sums.T.tolist(), sizes.tolist()
        for i, start in enumerate(starts):
            if not same[i]:
                state = fresh | {c: v[i] for c, v in given.items() if v[i] is not None}
            if before is not None and "_prev_close" in state:
                state["_prev_close"] = None if np.isnan(before[i]) else float(before[i])
            for c, column in out.items():
                column.append(state[c])
            lifted = {}
            for k, (source, alpha) in carry.averages.items():
                first, x, y, v = (column[i] for column in firsts[k])
                old, at = state[f"_in_{k}"], state[f"_at_{source}"]
                if first < 0:
                    continue
                if old is None:
                    lifted[k] = (0.0, y)
                    continue
                rows, q = start + first - at, 1.0 - alpha
                w = q if rows == 1 else q ** rows / (q ** rows + alpha)
                lifted[k] = (w * (old - x), y + v * w * (old - x))
            if carry.signal:
                key, fast, slow, alpha = carry.signal
                f, s, old = state[f"_in_{fast}"], state[f"_in_{slow}"], state[f"_in_{key}"]
                if old is not None or fast in lifted:
                    by_f, by_s = (lifted[k][0] if k in lifted else 0.0 for k in (fast, slow))
                    own = sums[i][0] + sums[i][1] * by_f - sums[i][2] * by_s
                    state[f"_in_{key}"] = own if old is None else (1.0 - alpha) ** sizes[i] * old + own + sums[i][3] * (f - s)
            for k, (_, y) in lifted.items():
                state[f"_in_{k}"] = y
            for s in carry.sources:
                if counts[s][i]:
                    state[f"_at_{s}"] = lasts[s][i]
                    state[f"_seen_{s}"] += counts[s][i]
        columns = [batch.column(c) for c in kept]
        columns += [pa.array(v, pa.int64() if c.startswith(WHOLE) else pa.float64()) for c, v in out.items()]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, *out])
