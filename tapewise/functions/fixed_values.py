"""Names, phrases and thresholds that results must show exactly.

Ladders are lists of (bound, text): the first text whose bound lies strictly below the value, else the last.
"""

# Default watch list.

# Company names used when the metadata table has no row.
COMPANY_NAMES = {
    "RELIANCE.NS": "Reliance Industries",
    "TCS.NS": "Tata Consultancy Services",
    "INFY.NS": "Infosys",
    "HDFCBANK.NS": "HDFC Bank",
    "WIPRO.NS": "Wipro",
}

# Search phrase of the news source per ticker.
NEWS_QUERIES = {
    "RELIANCE.NS": "Reliance Industries",
    "TCS.NS": "Tata Consultancy Services TCS",
    "INFY.NS": "Infosys",
    "HDFCBANK.NS": "HDFC Bank",
    "WIPRO.NS": "Wipro",
}

# Readable name of a feature.
FEATURE_LABELS = {
    "sma_20": "20-day moving average",
    "sma_50": "50-day moving average",
    "ema_20": "20-day exponential moving average",
    "rsi": "RSI momentum indicator",
    "rsi_normalized": "RSI momentum indicator",
    "macd": "MACD trend indicator",
    "macd_signal": "MACD signal line",
    "macd_hist": "MACD momentum histogram",
    "bb_pct": "Bollinger Band position",
    "bb_width": "Bollinger Band width (volatility)",
    "bb_upper": "Bollinger upper band",
    "bb_lower": "Bollinger lower band",
    "volume_ratio": "trading volume vs average",
    "price_vs_sma20": "price position vs 20-day average",
    "price_vs_sma50": "price position vs 50-day average",
    "sentiment_1d": "1-day news sentiment",
    "sentiment_3d": "3-day news sentiment trend",
    "sentiment_7d": "7-day news sentiment trend",
    "sentiment_momentum": "news sentiment momentum",
}

# What a feature measures.
FEATURE_DESCRIPTIONS = {
    "sma_50": "whether the stock's medium-term trend is up or down",
    "sma_20": "whether the stock's short-term trend is up or down",
    "macd_hist": "whether momentum is accelerating or decelerating",
    "macd_signal": "the smoothed momentum trend direction",
    "macd": "the overall momentum trend",
    "price_vs_sma50": "how far the price is from its long-term average",
    "price_vs_sma20": "how far the price is from its short-term average",
    "rsi": "whether the stock is overbought or oversold",
    "rsi_normalized": "whether the stock is overbought or oversold",
    "bb_pct": "where the price sits within its normal trading range",
    "bb_width": "how volatile the stock has been recently",
    "volume_ratio": "whether trading activity is unusually high or low",
    "sentiment_3d": "the tone of recent news about this company",
    "sentiment_1d": "today's news sentiment about this company",
    "sentiment_momentum": "whether news sentiment is improving or worsening",
}

# Probability thresholds of the strategy sweep, label thresholds of the balance sweep.
STRATEGY_THRESHOLDS = [0.50, 0.52, 0.55, 0.58, 0.60, 0.65]
LABEL_THRESHOLDS = [0.0, 0.01, 0.02]
HORIZONS = [1, 3, 5, 10]

# Labels of sentiment scores, prediction confidence and contribution size.
SENTIMENT_LABELS = [
    (0.3, "STRONGLY POSITIVE"), (0.1, "MILDLY POSITIVE"), (-0.1, "NEUTRAL"), (-0.3, "MILDLY NEGATIVE"),
    (None, "STRONGLY NEGATIVE"),
]
CONFIDENCE_LABELS = [(0.2, "high"), (0.1, "medium"), (None, "low")]
STRENGTH_LABELS = [(0.3, "strongly"), (0.15, "moderately"), (None, "mildly")]

# Zones of the indicator texts.
RSI_ZONES = [
    (70, "OVERBOUGHT. Stock has risen sharply recently. Potential reversal risk."),
    (60, "Approaching overbought. Bullish momentum but getting stretched."),
    (40, "NEUTRAL zone. No strong signal either way."),
    (30, "Approaching oversold. Mild bearish pressure."),
    (None, "OVERSOLD. Stock has fallen sharply. Potential bounce candidate."),
]
BAND_ZONES = [
    (1.0, "ABOVE upper band — strongly overbought on volatility basis"),
    (0.8, "Near UPPER band — price elevated, watch for pullback"),
    (0.2, "MIDDLE of bands — no extreme volatility signal"),
    (0.0, "Near LOWER band — price depressed, watch for bounce"),
    (None, "BELOW lower band — strongly oversold on volatility basis"),
]
VOLUME_ZONES = [
    (3.0, "EXTREMELY high. Major institutional activity likely."),
    (2.0, "Very high volume. Strong conviction in today's move."),
    (1.2, "Above average. Moderate conviction."),
    (0.8, "Normal volume. No unusual activity."),
    (None, "Below average. Low conviction — weak signal day."),
]
VOLATILITY_ZONES = [(3.0, "HIGH"), (1.5, "MODERATE"), (None, "LOW")]

# Two-way phrases of the indicator texts: (when true, otherwise).
MACD_SIDES = ("BULLISH crossover (MACD above Signal)", "BEARISH crossover (MACD below Signal)")
MACD_MOMENTUM = ("ACCELERATING (histogram growing)", "DECELERATING (histogram shrinking/negative)")
BAND_SQUEEZE = ("SQUEEZE (bands very tight — big move brewing)", "Normal band width")
AVERAGE_CROSS = ("GOLDEN CROSS setup (SMA20 > SMA50 — bullish)", "DEATH CROSS setup (SMA20 < SMA50 — bearish)")

# Formats of the indicator texts and of the fallback explanation.
RSI_FORMAT = "RSI = %.1f — %s"
MACD_FORMAT = "MACD = %.3f, Signal = %.3f — %s. Momentum: %s"
BAND_FORMAT = "BB%%B = %.2f — %s. Band width = %.3f — %s."
AVERAGE_FORMAT = "Price ₹%.2f is %s SMA20 (₹%.2f) and %s SMA50 (₹%.2f). %s."
VOLUME_FORMAT = "Volume ratio = %.2fx — %s"
ATR_FORMAT = "ATR = ₹%.2f (%.2f%% of price) — %s volatility. Expect ~₹%.0f daily price swing on average."
TOOLTIP_FORMAT = "%s is currently %.2f."
EXPLANATION_FORMAT = (
    "%s shows a %s%% probability of a price %s over the next 10 trading days. "
    "The strongest signal comes from the %s, which is currently %s. "
    "Model confidence is %s. Remember: this is a probability estimate, not a guarantee."
)
NO_FEATURE_LABEL, NO_FEATURE_DIRECTION = "technical indicators", "neutral"
