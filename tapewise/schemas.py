"""Explicit schemas of the stored tables. Nothing in the library infers a schema."""

from pyspark.sql import types as T


def _struct(key: list[tuple[str, T.DataType]], doubles: list[str]) -> T.StructType:
    fields = [T.StructField(name, kind, False) for name, kind in key]
    return T.StructType(fields + [T.StructField(name, T.DoubleType(), True) for name in doubles])


_KEY = [("ticker", T.StringType()), ("date", T.DateType())]

PRICE_COLUMNS = ["open", "high", "low", "close"]
INDICATOR_COLUMNS = [
    "sma_20", "sma_50", "ema_20", "rsi", "macd", "macd_signal", "macd_hist",
    "bb_upper", "bb_lower", "bb_width", "bb_pct", "volume_ratio",
]
# Computed with the stored indicators; kept in the same table.
EXTRA_INDICATOR_COLUMNS = ["rsi_signal", "atr", "atr_pct"]
SENTIMENT_COLUMNS = ["sentiment_1d", "sentiment_3d", "sentiment_7d", "sentiment_momentum"]

FEATURES = [
    "rsi", "macd", "macd_signal", "macd_hist", "bb_pct", "bb_width", "sma_20", "sma_50",
    "ema_20", "volume_ratio", "price_vs_sma20", "price_vs_sma50", "rsi_normalized",
]
FEATURES_WITH_SENTIMENT = FEATURES + SENTIMENT_COLUMNS

PRICES = _struct(_KEY, PRICE_COLUMNS).add("volume", T.LongType(), True)
INDICATORS = _struct(_KEY, INDICATOR_COLUMNS)
SENTIMENT = _struct(_KEY, SENTIMENT_COLUMNS).add("article_count", T.IntegerType(), True)
LOADS = (T.StructType().add("ticker", T.StringType()).add("rows", T.LongType()).add("first_date", T.DateType()).add("last_date", T.DateType())
         .add("loaded_at", T.TimestampType()).add("batch", T.StringType()))
FETCH_LOG = T.StructType().add("ticker", T.StringType(), False).add("last_fetched", T.TimestampType())

# One downloaded file per ticker; the ticker is in the file name, not in the rows.
RAW_BARS = (
    T.StructType()
    .add("Date", T.TimestampType())
    .add("Open", T.DoubleType()).add("High", T.DoubleType()).add("Low", T.DoubleType())
    .add("Close", T.DoubleType()).add("Volume", T.DoubleType())
)

ARTICLE = (
    T.StructType()
    .add("source", T.StructType().add("id", T.StringType()).add("name", T.StringType()))
    .add("title", T.StringType())
    .add("description", T.StringType())
    .add("publishedAt", T.StringType())
)
NEWS_PAYLOAD = (
    T.StructType()
    .add("ticker", T.StringType())
    .add("status", T.StringType())
    .add("articles", T.ArrayType(ARTICLE))
)

KNOWLEDGE = T.StructType([T.StructField(n, T.StringType()) for n in ["id", "topic", "title", "content"]])

CONTRIBUTION = (
    T.StructType()
    .add("feature", T.StringType()).add("value", T.DoubleType()).add("shap_value", T.DoubleType())
    .add("direction", T.StringType()).add("magnitude", T.DoubleType())
)
EXPLANATIONS = T.ArrayType(
    T.StructType().add("ticker", T.StringType()).add("date", T.DateType()).add("explanation", T.StringType())
)
