"""Feature joins, labels, splits and window layouts of the supervised dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.operators.panel import numbered, units_all, with_carry, with_halo
from tapewise.schemas import FEATURES, INDICATOR_COLUMNS, SENTIMENT_COLUMNS

KEY = ["ticker", "date"]


def features(prices: DataFrame, indicators: DataFrame, start: str | None = None) -> DataFrame:
    """Prices joined with indicators on the panel key."""
    joined = prices.select(*KEY, "close", "volume").join(indicators.select(*KEY, *INDICATOR_COLUMNS), KEY)
    return joined if start is None else joined.filter(F.col("date") >= F.lit(start).cast("date"))


def features_sentiment(prices: DataFrame, indicators: DataFrame, sentiment: DataFrame,
                       start: str | None = None) -> DataFrame:
    """Features with sentiment; days without sentiment read 0. Volume is not carried."""
    joined = features(prices, indicators, start).drop("volume")
    joined = joined.join(sentiment.select(*KEY, *SENTIMENT_COLUMNS), KEY, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in SENTIMENT_COLUMNS})


def derived_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "price_vs_sma20": F.try_divide("close", "sma_20") - 1,
        "price_vs_sma50": F.try_divide("close", "sma_50") - 1,
        "rsi_normalized": (F.col("rsi") - 50) / 50,
    })


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def forward_label(df: DataFrame, horizon: int = 10, threshold: float = 0.0) -> DataFrame:
    """label = 1 when close rises by more than ``threshold`` within ``horizon`` rows; tail rows dropped."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    h = with_halo(df, ahead=horizon)
    h = h.add({"_future": F.lead("close", horizon).over(h.w)})
    rise = F.try_divide(F.col("_future") - F.col("close"), F.col("close"))
    labelled = h.add({"label": F.when(rise > threshold, 1).otherwise(0)}).done("pos", "n_rows")
    return labelled.filter(F.col("_future").isNotNull()).drop("_future")


def forward_labels(df: DataFrame, horizons: list[int], threshold: float = 0.0) -> DataFrame:
    """One label column per horizon (``label_h``, null in the tail) from one pass over the panel."""
    h = with_halo(df, ahead=max(horizons))
    h = h.add({f"_f{n}": F.lead("close", n).over(h.w) for n in horizons})
    labels = {}
    for n in horizons:
        future = F.col(f"_f{n}")
        rise = F.try_divide(future - F.col("close"), F.col("close"))
        labels[f"label_{n}"] = F.when(future.isNotNull(), F.when(rise > threshold, 1).otherwise(0))
    return h.add(labels).done("pos", "n_rows", *[f"_f{n}" for n in horizons])


def dataset(feature_rows: DataFrame, horizon: int = 10, threshold: float = 0.0,
            columns: list[str] | None = None) -> DataFrame:
    """Feature columns, close and label of every usable row."""
    columns = columns or FEATURES
    rows = derived_features(forward_label(feature_rows, horizon, threshold))
    return drop_incomplete(rows, columns).select(*KEY, "close", *columns, "label")


def min_history(df: DataFrame, rows: int = 100) -> DataFrame:
    """Keep tickers with at least ``rows`` rows."""
    counted = with_carry(df, [F.count(F.lit(1)).alias("_cnt")],
                         [{"_total": F.sum("_cnt").over(units_all())}], ["_total"], windowed=False)
    return counted.filter(F.col("_total") >= rows).drop("_total", "_unit")


def train_rows(n: Column, test_size: float = 0.2) -> Column:
    return F.floor(n * F.lit(1 - test_size)).cast("long")


def chronological_split(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Add ``split``: the first int(n*(1-test_size)) rows of a ticker are "train", the rest "test"."""
    n = numbered(df)
    return n.withColumn("split", F.when(F.col("pos") < train_rows(F.col("n_rows"), test_size), "train")
                        .otherwise("test"))


def calibration_slice(df: DataFrame, test_size: float = 0.2, share: float = 0.2) -> DataFrame:
    """The last int(share*n_train) training rows."""
    n_train = train_rows(F.col("n_rows"), test_size)
    first = n_train - F.floor(n_train * F.lit(share)).cast("long")
    return numbered(df).filter((F.col("pos") >= first) & (F.col("pos") < n_train))


def fold_of(pos: Column, n: Column, k: int = 3) -> Column:
    """Expanding fold (1..k) in whose test part a row lies; null before the first test part."""
    size = F.floor(n / F.lit(k + 1)).cast("long")
    fold = F.lit(k) - F.floor(F.try_divide(n - 1 - pos, size)).cast("long")
    return F.when(fold >= 1, fold)


def expanding_folds(df: DataFrame, k: int = 3) -> DataFrame:
    """Per ticker and fold: training and test sizes and the dates of the test part."""
    rows = numbered(df).withColumn("fold", fold_of(F.col("pos"), F.col("n_rows"), k)).filter("fold is not null")
    return rows.groupBy("ticker", "fold").agg(
        F.min("pos").alias("n_train"), F.count(F.lit(1)).alias("n_val"),
        F.min("date").alias("val_start"), F.max("date").alias("val_end"),
    )


def with_windows(df: DataFrame, initial: float = 0.5, step: int = 21, min_train: int = 150) -> DataFrame:
    """Add ``window`` (test block of the row, null for rows that only train) and ``train_size``.

    The training set of a window is every row with pos < train_size; it is never copied per window.
    """
    rows = numbered(df)
    start = F.floor(F.col("n_rows") * F.lit(initial)).cast("long")
    block = F.floor((F.col("pos") - start) / F.lit(step)).cast("long")
    train = start + block * step
    skipped = F.greatest(F.lit(0), F.ceil((F.lit(min_train) - start) / F.lit(step))).cast("long")
    usable = (F.col("pos") >= start) & (train >= min_train)
    return rows.withColumns({"window": F.when(usable, block - skipped), "train_size": F.when(usable, train)})


def walkforward_windows(df: DataFrame, initial: float = 0.5, step: int = 21, min_train: int = 150) -> DataFrame:
    rows = with_windows(df, initial, step, min_train).filter("window is not null")
    return rows.groupBy("ticker", "window").agg(
        F.min("train_size").alias("train_size"), F.min("date").alias("test_start"),
        F.max("date").alias("test_end"), F.count(F.lit(1)).alias("test_size"),
        F.avg("label").alias("up_rate"),
    )
