"""Technical indicators of daily bars. Input: ticker, date, open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.operators.averages import Carry
from tapewise.operators.panel import Halo, block_rows, span_alpha, with_halo

_SERIES = {"gain": "_gain", "loss": "_loss", "range": "_tr"}
EPSILON = 1e-10  # keeps the gain/loss ratio finite when there was no loss


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def daily_return(df: DataFrame) -> DataFrame:
    """Percent change of close; direction is "down" for the first, undefined, return."""
    h = with_halo(df, back=1)
    h = h.add({"_prev": F.lag("close").over(h.w)})
    h = h.add({"daily_return": _ratio(F.col("close") - F.col("_prev"), F.col("_prev")) * 100})
    return h.add({"direction": F.when(F.col("daily_return") > 0, "up").otherwise("down")}).done("_prev")


def sma(df: DataFrame, window: int, column: str = "close", name: str | None = None) -> DataFrame:
    h = with_halo(df, back=window - 1)
    return h.add({name or f"sma_{window}": h.rolling_mean(column, window)}).done()


def ema(df: DataFrame, window: int, column: str = "close", name: str | None = None) -> DataFrame:
    name, alpha = name or f"ema_{window}", span_alpha(window)
    return _averaged(df, Carry({name: (column, alpha)})).decay({name: (column, alpha, column)}).done()


def moving_averages(df: DataFrame) -> DataFrame:
    h = _averaged(df, Carry({"ema_20": ("close", span_alpha(20))}), back=50)
    h = h.add({"sma_20": h.rolling_mean("close", 20), "sma_50": h.rolling_mean("close", 50)})
    return h.decay({"ema_20": ("close", span_alpha(20), "close")}).done()


def sma_crossover(df: DataFrame) -> DataFrame:
    """+1/-1 position of SMA 20 against SMA 50 and its change (unknown averages count as below)."""
    h = with_halo(df, back=50)
    h = h.add({"sma_20": h.rolling_mean("close", 20), "sma_50": h.rolling_mean("close", 50)})
    h = h.add({"ma_position": F.when(F.col("sma_20") > F.col("sma_50"), 1).otherwise(-1)})
    return h.add({"ma_signal": F.col("ma_position") - F.lag("ma_position").over(h.w)}).done()


def _averaged(df: DataFrame, carry: Carry, back: int = 1, units: DataFrame | None = None) -> Halo:
    """Blocks as long as the decays allow, with ``back`` earlier rows for the windows and the averages' states before them."""
    alphas = [alpha for _, alpha in carry.averages.values()] + ([carry.signal[3]] if carry.signal else [])
    return with_halo(df, back=back, block=block_rows(alphas, back), carry=carry, units=units)


def _known(column: str) -> Column:
    """The value, null where it is unknown: null or NaN."""
    return F.when(~F.isnan(F.col(column).cast("double")), F.col(column))


def _before(h: Halo) -> Column:
    """The close of the row before; that before the block's first row is carried."""
    lag = F.lag(_known("close")).over(h.w)
    return F.when(F.col("pos") == F.col("_first"), F.col("_prev_close")).otherwise(lag) if "_prev_close" in h.df.columns else lag


def _gain_loss(h: Halo) -> Halo:
    h = h.add({"_change": _known("close") - _before(h)})
    zero, known = F.lit(0.0), F.col("_change").isNotNull()  # an unknown change is neither a gain nor a loss
    return h.add({"_gain": F.when(known, F.greatest(F.col("_change"), zero)), "_loss": F.when(known, F.greatest(-F.col("_change"), zero))})


def _rsi(h: Halo, window: int) -> Column:
    """Null until ``window`` changes are known."""
    strength = F.col("_avg_gain") / (F.col("_avg_loss") + F.lit(EPSILON))
    changes = F.col("_seen_gain") + F.count("_change").over(h.w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(changes >= window, 100.0 - 100.0 / (1.0 + strength))


def rsi_signal(rsi: Column, overbought: float = 70, oversold: float = 30) -> Column:
    return F.when(rsi > overbought, -1).when(rsi < oversold, 1).otherwise(0)


def rsi(df: DataFrame, window: int = 14, name: str = "rsi") -> DataFrame:
    alpha = 1.0 / window
    h = _gain_loss(_averaged(df, Carry({"_avg_gain": ("gain", alpha), "_avg_loss": ("loss", alpha)}), back=0))
    h = h.decay({"_avg_gain": ("_gain", alpha, "gain"), "_avg_loss": ("_loss", alpha, "loss")})
    return h.add({name: _rsi(h, window)}).done("_change", "_gain", "_loss", "_avg_gain", "_avg_loss")


def _macd_carry(fast: int, slow: int, signal: int) -> Carry:
    return Carry({"_fast": ("close", span_alpha(fast)), "_slow": ("close", span_alpha(slow))}, ("macd_signal", "_fast", "_slow", span_alpha(signal)))


def _macd(h: Halo, carry: Carry) -> Halo:
    h = h.decay({k: (source, alpha, source) for k, (source, alpha) in carry.averages.items()})
    return h.add({"macd": F.col("_fast") - F.col("_slow")}).decay({"macd_signal": ("macd", carry.signal[3], None)})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    carry = _macd_carry(fast, slow, signal)
    h = _macd(_averaged(df, carry, back=0), carry)
    return h.add({"macd_hist": F.col("macd") - F.col("macd_signal")}).done("_fast", "_slow")


def macd_crossover(df: DataFrame) -> DataFrame:
    """+1 when MACD crosses above its signal line, -1 below, 0 otherwise, null on the first row."""
    carry = _macd_carry(12, 26, 9)
    h = _macd(_averaged(df, carry), carry)
    h = h.add({"_above": (F.col("macd") > F.col("macd_signal")).cast("int")})
    return h.add({"macd_cross": F.col("_above") - F.lag("_above").over(h.w)}).done("_above", "_fast", "_slow")


def bollinger(df: DataFrame, window: int = 20, num_std: float = 2.0) -> DataFrame:
    h = with_halo(df, back=window - 1)
    h = h.add({"bb_middle": h.rolling_mean("close", window), "_std": h.rolling_std("close", window)})
    return _bands(h, num_std).done("_std")


def _bands(h: Halo, num_std: float) -> Halo:
    middle, half = F.col("bb_middle"), F.col("_std") * num_std
    h = h.add({"bb_upper": middle + half, "bb_lower": middle - half})
    width = F.col("bb_upper") - F.col("bb_lower")
    return h.add({"bb_width": _ratio(width, middle), "bb_pct": _ratio(F.col("close") - F.col("bb_lower"), width)})


def _true_range(h: Halo) -> Column:
    prev, high, low = _before(h), _known("high"), _known("low")
    # greatest() skips nulls, so the first row is high - low.
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def true_range(df: DataFrame) -> DataFrame:
    h = with_halo(df, back=1)
    return h.add({"true_range": _true_range(h)}).done()


def atr(df: DataFrame, window: int = 14) -> DataFrame:
    """Average true range rounded to 2, and as a percentage of close (from the rounded value) to 3."""
    alpha = span_alpha(window)
    h = _averaged(df, Carry({"_atr": ("range", alpha)}), back=0)
    h = h.add({"_tr": _true_range(h)})
    h = h.decay({"_atr": ("_tr", alpha, "range")}).add({"atr": F.round("_atr", 2)})
    return h.add({"atr_pct": F.round(_ratio(F.col("atr"), F.col("close")) * 100, 3)}).done("_tr", "_atr")


def volume_ratio(df: DataFrame, window: int = 20) -> DataFrame:
    h = with_halo(df, back=window - 1)
    return h.add({"volume_ratio": _ratio(F.col("volume"), h.rolling_mean("volume", window))}).done()


#: Rows before a bar that the rolling windows of all indicators look at; older ones count by the averages' states only.
ROLLING_ROWS = 50


def indicator_carry() -> Carry:
    """The averages of all indicators."""
    spans, wilder = {n: span_alpha(n) for n in (12, 14, 20, 26)}, 1.0 / 14
    return Carry({"ema_20": ("close", spans[20]), "_fast": ("close", spans[12]), "_slow": ("close", spans[26]),
                  "_avg_gain": ("gain", wilder), "_avg_loss": ("loss", wilder), "_atr": ("range", spans[14])},
                 ("macd_signal", "_fast", "_slow", span_alpha(9)))


def indicators_all(df: DataFrame, complete_only: bool = True, units: DataFrame | None = None) -> DataFrame:
    """Every indicator in one pass: one exchange and one sort on (ticker, block) feed all windows.

    ``units``: the unit table of ``df`` for ``indicator_carry``, where it is there already (see ``panel.unit_states``).
    """
    carry = indicator_carry()
    h = _averaged(df, carry, back=ROLLING_ROWS, units=units)
    h = _gain_loss(h.add({
        "_tr": _true_range(h),
        "sma_20": h.rolling_mean("close", 20),
        "sma_50": h.rolling_mean("close", 50),
        "_std": h.rolling_std("close", 20),
        "volume_ratio": _ratio(F.col("volume"), h.rolling_mean("volume", 20)),
    }))
    h = h.decay({k: (_SERIES.get(source, source), alpha, source) for k, (source, alpha) in carry.averages.items()})
    h = h.add({"macd": F.col("_fast") - F.col("_slow"), "bb_middle": F.col("sma_20")})
    h = h.decay({"macd_signal": ("macd", carry.signal[3], None)})
    h = _bands(h, 2.0).add({
        "rsi": _rsi(h, 14),
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        "atr": F.round("_atr", 2),
    })
    h = h.add({
        "rsi_signal": rsi_signal(F.col("rsi")),
        "atr_pct": F.round(_ratio(F.col("atr"), F.col("close")) * 100, 3),
    })
    out = h.done("_tr", "_std", "_change", "_gain", "_loss", "_avg_gain", "_avg_loss", "_atr", "_fast", "_slow", "bb_middle",
                 "pos", "n_rows")
    return out.dropna(how="any") if complete_only else out
