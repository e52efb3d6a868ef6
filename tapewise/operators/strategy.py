"""Threshold strategy on predicted probabilities: equity, drawdown and risk figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.operators.panel import in_unit, unit_of, with_carry, with_halo
from tapewise.sources.staging import written

KEY = ["ticker", "date"]


def price_at_prediction(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    return predictions.join(prices.select(*KEY, F.col("close").alias("price")), KEY, "left")


def prediction_returns(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    """Return between successive *prediction* dates (0 on the first) and the two probabilities before."""
    h = with_halo(price_at_prediction(predictions, prices).select(*KEY, "prob", "price"), back=2)
    h = h.add({"_p": F.lag("price").over(h.w), "prev_prob": F.lag("prob").over(h.w), "prev2_prob": F.lag("prob", 2).over(h.w)})
    r = F.coalesce(F.try_divide(F.col("price") - F.col("_p"), F.col("_p")), F.lit(0.0))
    return h.add({"market_return": r}).done("_p", "pos", "n_rows")


def full_series_returns(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    """Return taken on the whole price series first, then restricted to the prediction dates."""
    h = with_halo(prices.select(*KEY, F.col("close").alias("price")), back=1)
    h = h.add({"_p": F.lag("price").over(h.w)})
    r = F.coalesce(F.try_divide(F.col("price") - F.col("_p"), F.col("_p")), F.lit(0.0))
    returns = h.add({"market_return": r}).done("_p", "pos", "n_rows")
    return predictions.select(*KEY, "prob").join(returns, KEY).withColumn("prev_prob", F.col("prob"))


def strategy_equity(returns: DataFrame, thresholds: list[float] = [0.55], cost: float = 0.001,
                    lag_position: bool = False) -> DataFrame:
    """Daily position, cost, cumulative strategy and buy-and-hold value, drawdown, per threshold.

    The position of a day earns the return into that day and the first position is free. That looks ahead,
    since the day's probability is known at its end only: with ``lag_position`` the day before decides (out
    of the market on the first day; needs ``prev2_prob``). Cumulative
    values multiply a product inside the quarter with the product of all earlier quarters, so a long
    history is never in one task.
    """
    rows = returns.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    now, earlier = ("prev_prob", "prev2_prob") if lag_position else ("prob", "prev_prob")
    on = F.coalesce((F.col(now) > F.col("threshold")).cast("double"), F.lit(0.0))
    before = F.coalesce((F.col(earlier) > F.col("threshold")).cast("double"), on)
    rows = rows.withColumns({"position": on, "change": F.abs(on - before)})
    gain = F.col("position") * F.col("market_return") - F.col("change") * F.lit(cost)
    rows = rows.withColumn("strategy_return", gain)
    return _cumulate(rows.withColumns({"_s": 1 + gain, "_b": 1 + F.col("market_return")})).drop("_s", "_b")


def _cumulate(rows: DataFrame) -> DataFrame:
    keys = ("ticker", "threshold")
    one = F.lit(1.0)
    span = in_unit(keys=keys).rowsBetween(Window.unboundedPreceding, 0)
    # Inside the quarter: running products, and their running extremes (a factor may be negative).
    local = rows.withColumn("_unit", unit_of()).withColumns({
        "_ls": F.product("_s").over(span), "_lb": F.product("_b").over(span)})
    local = local.withColumns({"_hi": F.max("_ls").over(span), "_lo": F.min("_ls").over(span)}).drop("_unit")
    local = written(local, "running")  # read twice below: for the quarters' table and for the rows
    earlier = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)

    def highest(scale: str, top: str, low: str) -> Column:
        return F.greatest(F.col(scale) * F.col(top), F.col(scale) * F.col(low))

    out = with_carry(
        local,
        [F.product("_s").alias("_ps"), F.product("_b").alias("_pb"),
         F.max("_ls").alias("_top"), F.min("_ls").alias("_low")],
        [{"_cs": F.coalesce(F.product("_ps").over(earlier), one),
          "_cb": F.coalesce(F.product("_pb").over(earlier), one)},
         {"_peak": F.max(highest("_cs", "_top", "_low")).over(earlier)}],
        ["_cs", "_cb", "_peak"], keys=keys, windowed=False,
    )
    out = out.withColumns({
        "cum_strategy": F.col("_cs") * F.col("_ls"), "cum_buyhold": F.col("_cb") * F.col("_lb"),
        "running_max": F.greatest("_peak", highest("_cs", "_hi", "_lo"))})
    drop = F.try_divide(F.col("cum_strategy") - F.col("running_max"), F.col("running_max"))
    return out.withColumn("drawdown", drop).drop("_ls", "_lb", "_hi", "_lo", "_cs", "_cb", "_peak", "_unit")


def _annual(total: Column, days: Column) -> Column:
    return F.when(total >= -1, F.pow(1 + total, F.lit(252.0) / days) - 1)


def risk_metrics(equity: DataFrame) -> DataFrame:
    """Risk figures per ticker and threshold."""
    on, s = F.col("position") == 1, F.col("strategy_return")
    agg = equity.groupBy("ticker", "threshold").agg(
        F.max_by("cum_strategy", "date").alias("_cs"), F.max_by("cum_buyhold", "date").alias("_cb"),
        F.count(F.lit(1)).alias("_days"), F.avg(s).alias("_mean"), F.stddev_pop(s).alias("_std"),
        F.min("drawdown").alias("_dd"),
        F.sum((on & (s > 0)).cast("long")).alias("_wins"), F.sum(on.cast("long")).alias("days_invested"),
        F.sum(F.when(on & (s > 0), s)).alias("_gain"), F.sum(F.when(on & (s < 0), s)).alias("_loss"),
        F.sum("change").cast("long").alias("n_trades"),
    )
    total, bh = F.col("_cs") - 1, F.col("_cb") - 1
    sharpe = F.when(F.col("_std") > 0, F.try_divide("_mean", "_std") * math.sqrt(252)).otherwise(0.0)
    factor = F.when(F.col("_loss") < 0, F.try_divide(F.coalesce("_gain", F.lit(0.0)), F.abs("_loss"))).otherwise(999.0)
    return agg.select(
        "ticker", "threshold", F.round(total, 4).alias("total_return"),
        F.round(_annual(total, F.col("_days")), 4).alias("annual_return"),
        F.round(sharpe, 3).alias("sharpe_ratio"), F.round("_dd", 4).alias("max_drawdown"),
        F.round(F.coalesce(F.try_divide("_wins", "days_invested"), F.lit(0.0)), 4).alias("win_rate"),
        F.round(factor, 3).alias("profit_factor"), "n_trades", "days_invested",
        F.round(bh, 4).alias("bh_total_return"), F.round(_annual(bh, F.col("_days")), 4).alias("bh_annual_return"),
    )


def best_threshold(metrics: DataFrame) -> DataFrame:
    """Row with the best Sharpe ratio per ticker, the lowest threshold on ties."""
    rest = [c for c in metrics.columns if c != "ticker"]
    best = F.max_by(F.struct(*rest), F.struct("sharpe_ratio", -F.col("threshold")))
    return metrics.groupBy("ticker").agg(best.alias("_b")).select("ticker", "_b.*")


def alpha(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("alpha", F.col("annual_return") - F.col("bh_annual_return"))
