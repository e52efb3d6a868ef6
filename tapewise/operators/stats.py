"""Grouped statistics. Groups may be very large, so everything is an aggregation with map-side combine;
exact quantiles use ranks over value ranges instead of collecting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.operators.panel import in_unit, with_carry, with_halo
from tapewise.functions.fixed_values import LABEL_THRESHOLDS


def latest_row(df: DataFrame) -> DataFrame:
    """Last row per ticker, by partial aggregation: only one row per ticker and task is shuffled.

    One max_by per column keeps the buffers primitive, so numbers aggregate in a hash table without a sort.
    """
    rest = [c for c in df.columns if c not in ("ticker", "date")]
    return df.groupBy("ticker").agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in rest])


def _value_range(x: Column) -> Column:
    """Monotone integer range of a double, fine enough that a range holds few distinct values."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * 512).cast("long")


def quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row (keys, column, p, quantile).

    Distinct values are counted first; ranks then come from counts per value range plus a window
    inside one range, so no group is ever gathered whole.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                for c in columns]))
    counts = (df.select(*keys, pairs.alias("_p")).select(*keys, "_p.*").filter("value is not null")
              .groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("_n")))
    by = (*keys, "column")
    order = Window.partitionBy(*by).orderBy("_unit")
    ranked = with_carry(
        counts, [F.sum("_n").alias("_in")],
        [{"_below": F.coalesce(F.sum("_in").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
          "_total": F.sum("_in").over(Window.partitionBy(*by))}],
        ["_below", "_total"], unit=_value_range(F.col("value")), keys=by,
    )
    upto = F.col("_below") + F.sum("_n").over(
        in_unit("value", keys=by).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    place = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    at = (F.col("_total") - 1) * F.col("p")
    low = F.floor(at)
    high = F.least(low + 1, F.col("_total") - 1)

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_from")) & (rank < F.col("_upto"))

    picked = place.filter(holds(low) | holds(high)).groupBy(*by, "p").agg(
        F.max(F.when(holds(low), F.col("value"))).alias("_lo"),
        F.max(F.when(holds(high), F.col("value"))).alias("_hi"),
        F.first(at - low).alias("_w"),
    )
    return picked.select(*by, "p", (F.col("_lo") + F.col("_w") * (F.col("_hi") - F.col("_lo"))).alias("quantile"))


def describe(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per key and column."""
    keys = keys or ["ticker"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                for c in columns]))
    basic = df.select(*keys, pairs.alias("_p")).select(*keys, "_p.*").groupBy(*keys, "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    def at(p: float) -> Column:
        return F.max(F.when(F.col("p") == p, F.col("quantile")))

    quart = quantiles(df, keys, columns, [0.25, 0.5, 0.75]).groupBy(*keys, "column").agg(
        at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    return basic.join(quart, [*keys, "column"], "left")


def green_day_ratio(returns: DataFrame) -> DataFrame:
    up = F.when(F.col("daily_return") > 0, 1).otherwise(0)
    return returns.groupBy("ticker").agg(
        F.sum(up).alias("green_days"), F.count(F.lit(1)).alias("total_days"), F.avg(up).alias("green_ratio"))


def _first_of(value: str, best: str) -> list[Column]:
    """Value and date of the extreme of ``value``, earliest date on ties, as partial aggregates."""
    days = F.datediff("date", F.lit("1970-01-01").cast("date"))
    order = F.struct(value, -days) if best == "max" else F.struct(value, days)
    pick = F.max_by if best == "max" else F.min_by
    found = F.col(value).isNotNull()
    return [pick(F.when(found, F.struct(F.col(value).alias("v"), "date")), F.when(found, order))]


def best_worst_day(returns: DataFrame) -> DataFrame:
    out = returns.groupBy("ticker").agg(
        _first_of("daily_return", "max")[0].alias("b"), _first_of("daily_return", "min")[0].alias("w"))
    return out.select("ticker", F.col("b.date").alias("best_date"), F.col("b.v").alias("best_return"),
                      F.col("w.date").alias("worst_date"), F.col("w.v").alias("worst_return"))


def atr_stats(df: DataFrame) -> DataFrame:
    out = df.groupBy("ticker").agg(
        F.max_by("atr", "date").alias("current_atr"), F.max_by("atr_pct", "date").alias("current_atr_pct"),
        F.avg("atr").alias("avg_atr"),
        _first_of("atr", "max")[0].alias("hi"), _first_of("atr", "min")[0].alias("lo"))
    return out.select("ticker", "current_atr", "current_atr_pct", "avg_atr", F.col("hi.v").alias("max_atr"), F.col("hi.date").alias("max_date"),
                      F.col("lo.v").alias("min_atr"), F.col("lo.date").alias("min_date"))


def bb_squeeze_flag(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Is the last band width below its own ``share`` quantile?"""
    last = df.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("bb_width", "date").alias("bb_width"))
    bound = quantiles(df, ["ticker"], ["bb_width"], [share]).select("ticker", F.col("quantile").alias("width_bound"))
    return last.join(bound, "ticker", "left").withColumn(
        "squeeze", F.coalesce(F.col("bb_width") < F.col("width_bound"), F.lit(False)))


def class_balance(feature_rows: DataFrame, horizon: int = 5, thresholds: list[float] | None = None) -> DataFrame:
    """Share of UP labels for a sweep of thresholds over one pass of the panel."""
    h = with_halo(feature_rows.select("ticker", "date", "close"), ahead=horizon)
    h = h.add({"_future": F.lead("close", horizon).over(h.w)})
    rise = F.try_divide(F.col("_future") - F.col("close"), F.col("close"))
    rows = h.done().filter("_future is not null").select("ticker", rise.alias("_rise"))
    sweep = F.explode(F.array(*[F.lit(float(t)) for t in thresholds or LABEL_THRESHOLDS]))
    up = F.when(F.col("_rise") > F.col("threshold"), 1).otherwise(0)
    out = rows.withColumn("threshold", sweep).groupBy("ticker", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(up).alias("up"), F.avg(up).alias("up_rate"))
    rate = F.col("up_rate")
    return out.withColumn("balance", F.when(F.abs(rate - 0.5) < 0.05, "GOOD")
                          .when((rate > 0.6) | (rate < 0.4), "IMBALANCED").otherwise("ACCEPTABLE"))


def normalised_base100(df: DataFrame) -> DataFrame:
    """close / first close * 100."""
    first = F.first("_first").over(Window.partitionBy("ticker").orderBy("_unit"))
    rows = with_carry(df, [F.min_by("close", "date").alias("_first")], [{"_base": first}], ["_base"],
                      windowed=False)
    return rows.withColumn("normalised", F.try_divide("close", "_base") * 100).drop("_base", "_unit")


def oversold_event_study(df: DataFrame, horizon: int = 10, bound: float = 30) -> DataFrame:
    """Rows with RSI below ``bound`` and the return ``horizon`` rows later."""
    h = with_halo(df.select("ticker", "date", "close", "rsi"), ahead=horizon)
    h = h.add({"_exit": F.lead("close", horizon).over(h.w)})
    rows = h.done().filter((F.col("rsi") < bound) & F.col("_exit").isNotNull())
    gain = F.try_divide(F.col("_exit") - F.col("close"), F.col("close")) * 100
    return rows.select("ticker", "date", F.round("rsi", 1).alias("rsi"), F.round("close", 2).alias("entry_price"),
                       F.round("_exit", 2).alias("exit_price"), F.round(gain, 2).alias("return_pct"),
                       (gain > 0).alias("recovered"))


def event_study_summary(events: DataFrame) -> DataFrame:
    base = events.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col("recovered").cast("int")) * 100).alias("win_rate"),
        F.avg("return_pct").alias("mean_return"), F.max("return_pct").alias("best"),
        F.min("return_pct").alias("worst"))
    middle = quantiles(events, ["ticker"], ["return_pct"], [0.5]).select(
        "ticker", F.col("quantile").alias("median_return"))
    win, mean = F.col("win_rate"), F.col("mean_return")
    return base.join(middle, "ticker").withColumn(
        "verdict", F.when((win > 60) & (mean > 0), "EFFECTIVE").when(win > 50, "MILD").otherwise("WEAK"))
