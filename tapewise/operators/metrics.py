"""Classifier metrics over a predictions table (prob, actual, pred), grouped by any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.operators.panel import in_unit, units_before, with_carry, with_halo
from tapewise.sources.staging import written

_GRID = 1 << 16  # score ranges of the distributed AUC


def _hit() -> Column:
    return (F.col("pred") == F.col("actual")).cast("int")


def _ranked(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Counts per distinct score with ``_wins``: positives times negatives below, ties by half.

    Negatives of lower score ranges come from a table of at most ``_GRID`` rows per group, those inside
    the range from a window over its distinct scores, so a group is never in one task.
    """
    counts = df.groupBy(*keys, F.col("prob").alias("_score")).agg(
        F.sum((F.col("actual") == 1).cast("long")).alias("_pos"),
        F.sum((F.col("actual") == 0).cast("long")).alias("_neg"), *[c.alias(n) for n, c in sums.items()])
    order = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_carry(counts, [F.sum("_neg").alias("_n")],
                      [{"_below": F.coalesce(F.sum("_n").over(order), F.lit(0))}], ["_below"],
                      unit=F.floor(F.col("_score") * _GRID).cast("long"), keys=tuple(keys))
    inside = F.sum("_neg").over(in_unit("_score", keys=tuple(keys)).rowsBetween(Window.unboundedPreceding, 0))
    lower = F.col("_below") + inside - F.col("_neg")
    return rows.withColumn("_wins", F.col("_pos") * (lower + F.col("_neg") / 2.0))


def _auc() -> Column:
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return F.coalesce(F.try_divide(F.sum("_wins"), pairs), F.lit(0.5)).alias("roc_auc")


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank AUC with ties; 0.5 where only one class is present."""
    return _ranked(df, keys, {}).groupBy(*keys).agg(_auc())


def accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(_hit()).alias("accuracy"))


def scorecard(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, UP rate and AUC per group from one set of per-score counts."""
    n = F.sum(F.col("_pos") + F.col("_neg"))
    return _ranked(df, keys, {"_hits": F.sum(_hit())}).groupBy(*keys).agg(
        n.alias("n"), F.try_divide(F.sum("_hits"), n).alias("accuracy"),
        F.try_divide(F.sum("_pos"), n).alias("up_rate"), _auc())


def confusion_matrix(df: DataFrame, keys: list[str]) -> DataFrame:
    def cell(a: int, p: int) -> Column:
        return F.sum(((F.col("actual") == a) & (F.col("pred") == p)).cast("long"))

    return df.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                 cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def classification_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def rates(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            return F.coalesce(F.try_divide(a, b), F.lit(0.0))

        return F.struct(F.lit(name).alias("class"), part(hit, hit + wrong).alias("precision"),
                        part(hit, hit + missed).alias("recall"),
                        part(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))

    both = F.explode(F.array(rates("DOWN", tn, fn, fp), rates("UP", tp, fp, fn)))
    return confusion_matrix(df, keys).select(*keys, both.alias("_r")).select(*keys, "_r.*")


def baselines(split: DataFrame) -> DataFrame:
    """Test accuracy of always UP, always DOWN and the majority class of the training rows."""
    test, train = F.col("split") == "test", F.col("split") == "train"
    out = split.groupBy("ticker").agg(
        F.avg(F.when(test, F.col("label"))).alias("always_up"),
        F.sum(F.when(train, F.col("label"))).alias("_up"),
        F.sum(F.when(train, 1 - F.col("label"))).alias("_down"))
    out = out.withColumn("majority_class", (F.col("_up") > F.col("_down")).cast("int"))
    down = 1 - F.col("always_up")
    return out.select("ticker", "majority_class", "always_up", down.alias("always_down"),
                      F.when(F.col("majority_class") == 1, F.col("always_up")).otherwise(down).alias("majority"))


def calibration_curve(df: DataFrame, keys: list[str], bins: int = 8) -> DataFrame:
    """Mean score and share of positives per equal-width bin; an edge belongs to the lower bin."""
    slot = F.greatest(F.ceil(F.col("prob") * bins) - 1, F.lit(0)).cast("int")
    return df.withColumn("bin", slot).groupBy(*keys, "bin").agg(
        F.avg("prob").alias("mean_prob"), F.avg("actual").alias("fraction_positive"))


def market_regime(prices: DataFrame, window: int = 200) -> DataFrame:
    """bull above the long moving average, else bear; the first ``window`` rows are unknown."""
    h = with_halo(prices.select("ticker", "date", "close"), back=window)
    h = h.add({"_avg": h.rolling_mean("close", window)})
    regime = F.when(F.col("pos") < window, "unknown").when(F.col("close") > F.col("_avg"), "bull").otherwise("bear")
    return h.add({"regime": regime}).done("_avg", "pos", "n_rows")


def regime_asof(predictions: DataFrame, regimes: DataFrame) -> DataFrame:
    """Each prediction with the latest regime at or before its date (both sides unique per ticker, date)."""
    known = regimes.select("ticker", "date", "regime", F.lit(0).alias("_side"))
    rest = [c for c in predictions.columns if c not in ("ticker", "date")]
    both = predictions.withColumn("_side", F.lit(1)).unionByName(known, allowMissingColumns=True)
    last = F.max_by("regime", F.when(F.col("regime").isNotNull(), F.col("date")))
    rows = with_carry(both, [last.alias("_l")],
                      [{"_prev": F.last("_l", ignorenulls=True).over(units_before())}], ["_prev"])
    seen = F.last("regime", ignorenulls=True).over(
        in_unit("date", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("regime", F.coalesce(seen, "_prev")).filter("_side = 1") \
        .select("ticker", "date", *rest, "regime")


def regime_performance(predictions: DataFrame, regimes: DataFrame, min_rows: int = 10) -> DataFrame:
    rows = regime_asof(predictions, regimes).filter(F.col("regime").isin("bull", "bear"))
    rows = written(rows.select("ticker", "regime", "prob", "actual", "pred"), "regime-predictions")
    return scorecard(rows, ["ticker", "regime"]).filter(F.col("n") >= min_rows).withColumnRenamed("n", "days")


def regime_verdict(performance: DataFrame) -> DataFrame:
    def auc(name: str) -> Column:
        return F.max(F.when(F.col("regime") == name, F.col("roc_auc")))

    out = performance.groupBy("ticker").agg(auc("bull").alias("bull_auc"), auc("bear").alias("bear_auc"))
    gap = F.col("bull_auc") - F.col("bear_auc")
    return out.filter(gap.isNotNull()).withColumn(
        "verdict", F.when(F.abs(gap) < 0.05, "CONSISTENT").when(gap > 0, "BETTER IN BULL").otherwise("BETTER IN BEAR"))


def window_results(predictions: DataFrame) -> DataFrame:
    """One row per (ticker, window) of walk-forward predictions. A window has a bounded number of rows."""
    keys = ["ticker", "window"]
    spans = predictions.groupBy(*keys).agg(
        F.min("train_size").alias("train_size"), F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    joined = spans.join(scorecard(predictions, keys).withColumnRenamed("n", "test_size"), keys)
    return joined.withColumns({c: F.round(c, 4) for c in ("accuracy", "roc_auc", "up_rate")})


def walkforward_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("roc_auc").alias("mean_auc"),
        F.stddev_samp("roc_auc").alias("std_auc"), F.min("roc_auc").alias("min_auc"),
        F.max("roc_auc").alias("max_auc"), F.sum((F.col("roc_auc") > 0.55).cast("long")).alias("good_windows"))
