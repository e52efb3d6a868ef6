"""Ordered work on a (ticker, date) panel without ever putting one ticker into one task.

``Window.partitionBy("ticker")`` over the rows would place the whole history of a ticker in one
task, and one ticker may hold a large share of all rows. Everything here works on bounded groups:

* a *unit* is one calendar quarter of one ticker. (ticker, date) is the key of the panel, so a unit
  has at most 92 rows whatever the skew;
* the *unit table* (one row per unit, built by a plain aggregation) is the only thing windowed per
  ticker. It has four rows a year per ticker, so that window is bounded by the calendar;
* :func:`with_carry` joins running per-ticker values from the unit table back onto the rows;
* a decaying average has no bounded reach; its state before each unit is carried by the unit table (:mod:`averages`);
* :func:`with_halo` cuts every ticker into blocks of consecutive rows and copies the few rows before
  (or after) a block into it, so any window of bounded reach runs inside (ticker, block).

The joins carry no broadcast hint: the unit table grows with the data, so its size decides (the
planner and adaptive execution broadcast it only below ``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewise.operators.averages import BEFORE, Carry

UNIT_ROWS = 92  # most days in a quarter: bound of a unit and slack of a block edge
BLOCK_ROWS = 3200  # with the longest usual halo still below the 4096 rows a window keeps in memory
LONG_WINDOW = 100  # rolling means of at least this many rows use running sums
_LOST = 17.0  # decimal digits after which a geometric tail no longer changes a double
_RANGE = 280.0  # decimal exponent a block may span in each direction


def unit_of(date: str = "date") -> Column:
    return (F.year(date) * 4 + F.quarter(date)).cast("int")


def units_before(ticker: str = "ticker") -> WindowSpec:
    """All earlier units of the ticker (for columns of the unit table)."""
    return Window.partitionBy(ticker).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)


def units_all(ticker: str = "ticker") -> WindowSpec:
    return Window.partitionBy(ticker)


def in_unit(*order: Column | str, keys: tuple[str, ...] = ("ticker",)) -> WindowSpec:
    """Window over the rows of one unit, for frames after :func:`with_carry`."""
    return Window.partitionBy(*keys, "_unit").orderBy(*(order or ("date",)))


def with_carry(
    df: DataFrame,
    summaries: list[Column],
    carries: list[dict[str, Column]],
    keep: list[str],
    unit: Column | None = None,
    keys: tuple[str, ...] = ("ticker",),
    windowed: bool = True,
) -> DataFrame:
    """Add ``_unit`` and the ``keep`` columns of the unit table to every row.

    ``summaries`` are aggregates per unit; each dict of ``carries`` is one step of window columns over
    the unit table (later steps may use earlier ones).

    ``windowed`` says that windows per unit follow, and spreads the rows by (keys, unit) for them. Without
    it an input that happens to be spread by ticker alone (after a join on ticker) would satisfy such a
    window as it is, with a whole ticker in one task. The exchange is the one the window needs anyway.
    """
    unit = unit_of() if unit is None else unit
    rows = df.withColumn("_unit", unit)
    table = rows.groupBy(*keys, "_unit").agg(*summaries)
    for step in carries:
        table = table.withColumns(step)
    out = rows.join(table.select(*keys, "_unit", *keep), [*keys, "_unit"])
    return out.repartition(*keys, "_unit") if windowed else out


def _starts() -> tuple[list[Column], list[dict[str, Column]]]:
    return (
        [F.count(F.lit(1)).alias("_cnt")],
        [{"_start": F.coalesce(F.sum("_cnt").over(units_before()), F.lit(0)),
          "n_rows": F.sum("_cnt").over(units_all())}],
    )


def numbered(df: DataFrame) -> DataFrame:
    """Add ``pos`` (0-based row number in date order) and ``n_rows`` per ticker."""
    summaries, carries = _starts()
    out = with_carry(df, summaries, carries, ["_start", "n_rows"])
    pos = F.col("_start") + F.row_number().over(in_unit()) - 1
    return out.withColumn("pos", pos).drop("_start", "_unit")


@dataclass(frozen=True)
class Halo:
    """A panel cut into blocks. ``w`` orders the rows of a block, copies included."""

    df: DataFrame
    back: int
    block: int

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy("ticker", "_block").orderBy("date")

    def last(self, n: int) -> WindowSpec:
        """The last ``n`` rows up to the current one."""
        return self.w.rowsBetween(1 - n, 0)

    def add(self, columns: dict[str, Column]) -> Halo:
        return Halo(self.df.withColumns(columns), self.back, self.block)

    def done(self, *drop: str) -> DataFrame:
        """Drop the copied rows and the helper columns."""
        carried = [c for c in self.df.columns if c.startswith(("_in_", "_at_", "_seen_", "_prev_"))]
        return self.df.filter("_home").drop("_home", "_block", "_first", *carried, *drop)

    def rolling_mean(self, column: str, n: int) -> Column:
        """Mean of the last ``n`` rows; null until ``n`` values are there.

        A sliding frame adds up all its rows again at every row. Long windows therefore take the difference
        of two running sums instead; the block bounds their length, so only the last few bits can differ.
        """
        if n < LONG_WINDOW:
            frame = self.last(n)
            return F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))
        now, before = (self.w.rowsBetween(Window.unboundedPreceding, end) for end in (0, -n))
        count = F.count(column).over(now) - F.count(column).over(before)
        total = F.sum(column).over(now) - F.coalesce(F.sum(column).over(before), F.lit(0))
        return F.when(count == n, total / n)

    def rolling_std(self, column: str, n: int) -> Column:
        frame = self.last(n)
        return F.when(F.count(column).over(frame) == n, F.stddev_samp(column).over(frame))

    def decay(self, averages: dict[str, tuple[str, float, str | None]]) -> Halo:
        """Add exponential averages, each of a column with an alpha: y = x at the first known value, then w*y + (1-w)*x.

        w is (1-alpha)^d / ((1-alpha)^d + alpha), where the known value before is d rows back: 1-alpha without
        gaps. A row without a value (null or NaN) repeats the average, rows before the first known one have none.
        The third part names the source whose last position :func:`with_halo` carries to the block (None: the average
        has a value in every row from its first on); the value before the block is carried as ``_in_`` and the name.
        Inside a block this is P * (y before + sum((1-w) * x / P)) with P the running product of w, kept as a
        sum of logarithms from the middle of the block so that it stays far from overflow.
        """
        so_far, before = (self.w.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
        sources = {c: f"_last_{k}" for k, c in enumerate(dict.fromkeys(c for c, _, _ in averages.values()))}
        value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in sources}
        carried = {c: F.col(f"_at_{source}") if source else F.when(F.col(f"_in_{name}").isNotNull(), F.col("_first") - 1)
                   for name, (c, _, source) in averages.items()}
        h = self.add({at: F.coalesce(F.last(F.when(value[c].isNotNull(), F.col("pos")), ignorenulls=True).over(before), carried[c])
                      for c, at in sources.items()})
        logs, sums, out, helpers = {}, {}, {}, [*sources.values()]
        for name, (column, alpha, _) in averages.items():
            x, at, q, earlier = value[column], F.col(sources[column]), 1.0 - alpha, F.col(f"_in_{name}")
            if alpha >= 1.0:
                out[name] = F.coalesce(F.last(x, ignorenulls=True).over(so_far), earlier)
                continue
            if (self.block + self.back + 2 * UNIT_ROWS) / 2 * -math.log10(q) > _RANGE:
                raise ValueError(f"block of {self.block} rows is too long for alpha={alpha}")
            gap = F.col("pos") - at
            old = F.pow(F.lit(q), gap.cast("double"))
            log = F.when(gap == 1, math.log(q)).otherwise(F.greatest(F.log(old / (old + alpha)), F.lit(-_LOST * math.log(10))))
            logs[f"_log_{name}"] = F.when(x.isNotNull() & at.isNotNull(), log).otherwise(0.0)
            middle = (self.block + self.back) / 2 * -math.log(q)
            sums[f"_sum_{name}"] = F.sum(f"_log_{name}").over(so_far) + middle
            total = F.col(f"_sum_{name}")
            share = F.when(at.isNull(), 1.0).when(gap == 1, alpha).otherwise(alpha / (old + alpha))
            own = F.sum(share * x * F.exp(-total)).over(so_far)
            both = F.when(earlier.isNull(), own).otherwise(earlier * math.exp(-middle) + F.coalesce(own, F.lit(0.0)))
            out[name] = F.when(x.isNotNull() & at.isNull(), x).otherwise(F.exp(total) * both)
            helpers += [f"_log_{name}", f"_sum_{name}"]
        h = h.add(logs).add(sums).add(out) if logs else h.add(out)
        return Halo(h.df.drop(*helpers), self.back, self.block)


def decay_rows(alpha: float) -> int:
    """Rows after which a weight (1-alpha)^n falls below 1e-17."""
    return 1 if alpha >= 1.0 else math.ceil(_LOST / -math.log10(1.0 - alpha))


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def block_rows(alphas: list[float], back: int) -> int:
    """Longest block (at most ``BLOCK_ROWS`` unless the halo is longer) that all ``alphas`` allow."""
    block = max(BLOCK_ROWS, back + UNIT_ROWS)
    for alpha in alphas:
        if alpha < 1.0:
            room = int(2 * _RANGE / -math.log10(1.0 - alpha)) - back - 2 * UNIT_ROWS
            block = min(block, room)
    return block


def unit_states(df: DataFrame, carry: Carry, before: DataFrame | None = None) -> DataFrame:
    """The unit table of ``df`` (ticker, _unit, _cnt, _start, n_rows) with the state of its averages before each unit.

    ``before`` has a ticker's ``_start`` and state before its first unit here, of tickers that begin earlier.
    """
    units = df.withColumn("_unit", unit_of()).groupBy("ticker", "_unit").agg(F.count(F.lit(1)).alias("_cnt"), carry.summary())
    earlier = F.lit(0)
    if before is not None:
        units = units.join(before.select("ticker", *(F.col(c).alias(BEFORE + c) for c in ("_start", *carry.columns))), "ticker", "left")
        earlier = F.coalesce(BEFORE + "_start", F.lit(0))
    units = units.withColumns({"_start": earlier + F.coalesce(F.sum("_cnt").over(units_before()), F.lit(0)),
                               "n_rows": earlier + F.sum("_cnt").over(units_all())})
    return carry.states(units, ("ticker",))


def with_halo(df: DataFrame, back: int = 0, ahead: int = 0, block: int | None = None, carry: Carry | None = None,
              units: DataFrame | None = None) -> Halo:
    """Cut every ticker into blocks of about ``block`` rows, each seeing ``back`` earlier and ``ahead``
    later rows. Adds ``pos`` and ``n_rows``. One row is copied at most twice, and only near an edge.

    With ``carry``, a block's rows also have the state of exponential averages before its first one, for ``decay``;
    ``units`` is its unit table where that is there already.
    """
    block = block or max(BLOCK_ROWS, max(back, ahead) + UNIT_ROWS)
    # A unit belongs to the block it starts in and may reach UNIT_ROWS into the next one. With this length
    # no row is needed more than one block away from its own.
    if max(back, ahead) + UNIT_ROWS > block:
        raise ValueError("a block must be longer than its halo by one unit")
    carried = carry.columns if carry else []
    if carry:
        units = unit_states(df, carry) if units is None else units
        rows = df.withColumn("_unit", unit_of()).join(units.select("ticker", "_unit", "_start", "_cnt", "n_rows", *carried), ["ticker", "_unit"])
    else:
        summaries, carries = _starts()
        rows = with_carry(df, summaries, carries, ["_start", "_cnt", "n_rows"], windowed=False)
    start, count, total = F.col("_start"), F.col("_cnt"), F.col("n_rows")
    home = F.floor(start / F.lit(block)).cast("long")
    seen_by = [F.struct(home.alias("_block"), F.lit(True).alias("_home"))]
    if back:
        # Late enough to be within `back` rows of the next block, and that block exists.
        late = (start + count > (home + 1) * block - back) & ((home + 1) * block <= total)
        seen_by.append(F.when(late, F.struct((home + 1).alias("_block"), F.lit(False).alias("_home"))))
    if ahead:
        early = (home > 0) & (start < home * block + UNIT_ROWS + ahead)
        seen_by.append(F.when(early, F.struct((home - 1).alias("_block"), F.lit(False).alias("_home"))))
    copies = rows.withColumn("_to", F.explode(F.array_compact(F.array(*seen_by)))) if len(seen_by) > 1 \
        else rows.withColumn("_to", seen_by[0])
    copies = copies.select(*df.columns, "n_rows", "_start", *carried, "_to._block", "_to._home")
    # See with_carry: never by ticker alone. The windows are work, not bytes, so a small exchange is not merged into few tasks.
    copies = copies.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker", "_block")
    # The first unit of the block holds its smallest start; same order as all later windows: one sort.
    w = Window.partitionBy("ticker", "_block").orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = {c: F.first(c).over(so_far) for c in carried}
    out = copies.withColumns({"_first": F.first("_start").over(so_far), "_row": F.row_number().over(w), **before})
    out = out.withColumn("pos", F.col("_first") + F.col("_row") - 1).drop("_start", "_row", *(() if carry else ("_first",)))
    return Halo(out, back, block)
