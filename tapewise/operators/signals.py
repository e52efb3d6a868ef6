"""Latest-bar views: overview rows, charts, signal cards and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions import scalar as S
from tapewise.functions.fixed_values import COMPANY_NAMES, NEWS_QUERIES
from tapewise.operators.stats import bb_squeeze_flag, latest_row


def price_range(prices: DataFrame, ticker: str | None = None, start: str | None = None,
                end: str | None = None) -> DataFrame:
    """Bars of a ticker between two inclusive dates, in date order. The filters reach the scan."""
    out = prices
    if ticker is not None:
        out = out.filter(F.col("ticker") == ticker)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out.orderBy("ticker", "date")


def watchlist(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose upper-cased ticker is on the list."""
    return rows.withColumn("ticker", F.upper("ticker")).join(
        listed.select(F.upper("ticker").alias("ticker")), "ticker", "left_semi")


def unknown_tickers(requested: DataFrame, listed: DataFrame) -> DataFrame:
    return requested.select(F.upper("ticker").alias("ticker")).join(
        listed.select(F.upper("ticker").alias("ticker")), "ticker", "left_anti")


def ticker_search(metadata: DataFrame, text: str) -> DataFrame:
    needle = text.lower()
    return metadata.filter(F.lower("ticker").contains(needle) | F.lower("company_name").contains(needle))


def company_name(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Name from metadata, else the fixed list, else the ticker."""
    joined = rows.join(metadata.select("ticker", F.col("company_name").alias("_name")), "ticker", "left")
    return joined.withColumn("company_name", F.coalesce("_name", S.lookup(F.col("ticker"), COMPANY_NAMES))).drop("_name")


def ticker_query(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """News search phrase per ticker, the ticker itself when none is known."""
    if queries is None:
        return rows.withColumn("query", S.lookup(F.col("ticker"), NEWS_QUERIES))
    return rows.join(queries, "ticker", "left").withColumn("query", F.coalesce("query", "ticker"))


def latest_signals(features: DataFrame) -> DataFrame:
    """Newest joined row per ticker with its side of SMA 50."""
    last = latest_row(features.select("ticker", "date", "close", "rsi", "macd_hist", "sma_50"))
    return last.withColumn("trend", F.when(F.col("close") > F.col("sma_50"), "Above SMA50").otherwise("Below SMA50"))


def market_overview(features: DataFrame, listed: DataFrame) -> DataFrame:
    return latest_signals(watchlist(features, listed)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def overview_badges(signals: DataFrame) -> DataFrame:
    colour = F.when(F.col("rsi") > 70, "#DC2626").when(F.col("rsi") < 30, "#16A34A").otherwise("#374151")
    return signals.withColumns({"rsi_color": colour, "momentum_up": F.col("macd_hist") > 0})


def price_chart(features: DataFrame, days: int = 90) -> DataFrame:
    """Last ``days`` rows per ticker, ready for a chart; every task keeps its own last ones before the exchange."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    rows = features.withColumn("_back", back).filter(F.col("_back") <= days)
    return rows.select("ticker", F.col("date").alias("day"), F.date_format("date", "dd MMM").alias("date"),
                       F.round("close", 2).alias("price"), F.round("sma_20", 2).alias("sma20"),
                       F.round("sma_50", 2).alias("sma50"), F.col("volume").cast("long").alias("volume"))


def _votes(low_rsi_is_bullish: bool):
    c = {n: F.col(n) for n in ("rsi", "macd", "macd_signal", "close", "sma_50", "bb_pct")}
    return S.bullish_votes(c["rsi"], c["macd"], c["macd_signal"], c["close"], c["sma_50"], c["bb_pct"],
                           low_rsi_is_bullish)


def bias_vote(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("bullish", _votes(False)).withColumn("bearish", 4 - F.col("bullish"))
    return out.withColumn("bias", S.bias(F.col("bullish"), ("BULLISH BIAS", "BEARISH BIAS", "NEUTRAL")))


def interpret_last_bar(indicators: DataFrame) -> DataFrame:
    last = bias_vote(latest_row(indicators))
    return last.select(
        "ticker", "date",
        S.ma_text(F.col("close"), F.col("sma_20"), F.col("sma_50")).alias("ma_text"),
        S.rsi_text(F.col("rsi")).alias("rsi_text"),
        S.macd_text(F.col("macd"), F.col("macd_signal"), F.col("macd_hist")).alias("macd_text"),
        S.bb_text(F.col("bb_pct"), F.col("bb_width")).alias("bb_text"),
        S.volume_text(F.col("volume_ratio")).alias("volume_text"),
        S.atr_text(F.col("atr"), F.col("atr_pct")).alias("atr_text"),
        "bullish", "bearish", "bias",
    )


def signal_card(indicators: DataFrame) -> DataFrame:
    squeeze = bb_squeeze_flag(indicators).select("ticker", "squeeze")
    last = latest_row(indicators).join(squeeze, "ticker").withColumn("bullish", _votes(True))
    rsi, pct = F.col("rsi"), F.col("bb_pct")
    return last.select(
        "ticker", "date", "close",
        F.when(rsi > 70, "OVERBOUGHT").when(rsi < 30, "OVERSOLD").otherwise("NEUTRAL").alias("rsi_label"),
        F.when(F.col("macd") > F.col("macd_signal"), "BULLISH").otherwise("BEARISH").alias("macd_label"),
        F.when(F.col("macd_hist") > 0, "accelerating").otherwise("decelerating").alias("momentum"),
        F.when(F.col("close") > F.col("sma_50"), "UPTREND").otherwise("DOWNTREND").alias("trend_label"),
        (F.try_divide(F.col("close") - F.col("sma_50"), F.col("sma_50")) * 100).alias("sma50_diff"),
        F.when(pct > 0.8, "UPPER BAND").when(pct < 0.2, "LOWER BAND").otherwise("MIDDLE").alias("bb_label"),
        "squeeze",
        F.when(F.col("atr_pct") > 2, "HIGH").otherwise("NORMAL").alias("volatility"),
        "bullish", (4 - F.col("bullish")).alias("bearish"),
        S.bias(F.col("bullish"), ("BULLISH", "BEARISH", "NEUTRAL")).alias("bias"),
    )
