"""Column-to-column functions: labels, buckets and texts. All of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewise.functions import fixed_values as V


def _ladder(x: Column, steps: list[tuple[float | None, str]]) -> Column:
    """First text whose bound is strictly below ``x``, else (also for null) the last one."""
    (first, text), *more, (_, rest) = steps
    out = F.when(x > first, text)
    for bound, label in more:
        out = out.when(x > bound, label)
    return out.otherwise(rest)


def _either(condition: Column, phrases: tuple[str, str]) -> Column:
    return F.when(condition, phrases[0]).otherwise(phrases[1])


def ten_thousandths(x: Column) -> Column:
    """A value of four decimals as a whole number, so sums and means stay exact."""
    return F.rint(x * 10000).cast("long")


def mean4(total: Column, n: Column) -> Column:
    """Mean of ten-thousandths, rounded half to even at four decimals."""
    return F.rint(F.try_divide(total.cast("double"), n.cast("double"))) / 10000


def sentiment_label(score: Column) -> Column:
    return _ladder(score, V.SENTIMENT_LABELS)


def confidence_bucket(prob: Column) -> Column:
    return _ladder(F.abs(prob - 0.5), V.CONFIDENCE_LABELS)


def signal_strength(magnitude: Column) -> Column:
    return _ladder(magnitude, V.STRENGTH_LABELS)


def rsi_text(rsi: Column) -> Column:
    return F.format_string(V.RSI_FORMAT, rsi, _ladder(rsi, V.RSI_ZONES))


def macd_text(macd: Column, signal: Column, hist: Column) -> Column:
    return F.format_string(V.MACD_FORMAT, macd, signal, _either(macd > signal, V.MACD_SIDES),
                           _either(hist > 0, V.MACD_MOMENTUM))


def bb_text(pct: Column, width: Column) -> Column:
    return F.format_string(V.BAND_FORMAT, pct, _ladder(pct, V.BAND_ZONES), width, _either(width < 0.05, V.BAND_SQUEEZE))


def ma_text(close: Column, sma20: Column, sma50: Column) -> Column:
    side = ("above", "below")
    return F.format_string(V.AVERAGE_FORMAT, close, _either(close > sma20, side), sma20, _either(close > sma50, side),
                           sma50, _either(sma20 > sma50, V.AVERAGE_CROSS))


def volume_text(ratio: Column) -> Column:
    return F.format_string(V.VOLUME_FORMAT, ratio, _ladder(ratio, V.VOLUME_ZONES))


def atr_text(atr: Column, atr_pct: Column) -> Column:
    return F.format_string(V.ATR_FORMAT, atr, atr_pct, _ladder(atr_pct, V.VOLATILITY_ZONES), atr)


def bullish_votes(rsi: Column, macd: Column, signal: Column, close: Column, sma50: Column, pct: Column,
                  low_rsi_is_bullish: bool = False) -> Column:
    """Votes out of four. The two users of the votes read RSI in opposite ways, hence the switch."""
    rsi_vote = rsi < 50 if low_rsi_is_bullish else rsi >= 50
    pct_vote = pct > 0.5 if low_rsi_is_bullish else pct >= 0.5
    votes = [rsi_vote, macd > signal, close > sma50, pct_vote]
    return sum((v.cast("int") for v in votes[1:]), votes[0].cast("int"))


def bias(votes: Column, names: tuple[str, str, str]) -> Column:
    return F.when(votes > 2, names[0]).when(votes < 2, names[1]).otherwise(names[2])


def indicator_tooltip(name: Column, value: Column) -> Column:
    return F.format_string(V.TOOLTIP_FORMAT, name, value)


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def headline_text(headline: Column, description: Column, limit: int | None = None) -> Column:
    """Headline and description joined for scoring; cut to ``limit`` characters for a scorer that asks for it."""
    head, tail = (F.trim(F.coalesce(c, F.lit(""))) for c in (headline, description))
    whole = F.when((tail != "") & (tail != "nan"), F.concat(head, F.lit(". "), tail)).otherwise(head)
    return whole if limit is None else F.substring(whole, 1, limit)


def lookup(key: Column, values: dict[str, str]) -> Column:
    """A lookup of fixed size as an expression; the key itself when unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def feature_label(feature: Column) -> Column:
    return lookup(feature, V.FEATURE_LABELS)


def feature_description(feature: Column) -> Column:
    return lookup(feature, V.FEATURE_DESCRIPTIONS)


def percent1(prob: Column) -> Column:
    """Probability as a percentage with one decimal, printed like 57.3."""
    return F.format_string("%.1f", F.round(prob * 100, 1))


def template_explanation(company: Column, prob: Column, confidence: Column,
                         top_feature: Column, top_direction: Column) -> Column:
    return F.format_string(
        V.EXPLANATION_FORMAT, company, percent1(prob), _either(prob > 0.5, ("rise", "fall")),
        F.coalesce(feature_label(top_feature), F.lit(V.NO_FEATURE_LABEL)),
        F.coalesce(top_direction, F.lit(V.NO_FEATURE_DIRECTION)), confidence)


def explanation_key(ticker: Column, date: Column, prob: Column, features: Column) -> Column:
    """Stable key: md5 of the JSON text of day, first three features, probability to 3 decimals, ticker."""
    names = F.concat_ws(", ", F.transform(F.slice(features, 1, 3), lambda f: F.concat(F.lit('"'), f, F.lit('"'))))
    content = F.concat(
        F.lit('{"date": "'), F.date_format(date, "yyyy-MM-dd"), F.lit('", "features": ['), names,
        F.lit('], "prob_up": '), F.round(prob, 3).cast("string"), F.lit(', "ticker": "'), ticker, F.lit('"}'))
    return F.concat(F.lit("explain:"), F.md5(content))
