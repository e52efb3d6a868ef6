"""Statistics, signal views, metrics, regimes and strategy queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapewise.functions import fixed_values as V
from tapewise.functions import scalar as S
from tapewise.functions.fixed_values import STRATEGY_THRESHOLDS
from tapewise.operators import features as feat
from tapewise.operators import indicators as ind
from tapewise.operators import metrics, stats, strategy
from tapewise.operators import signals as sig
from tapewise.plans.oracle import auc_ctes, div, equity_ctes, r, rx, sql
from tapewise.plans.registry import query, rounded
from tapewise.plans.tables import Tables
from tapewise.sources import store

LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM feat) z WHERE k = 1)"

# ---- statistics ----------------------------------------------------------------------------------------

_DESCRIBED = ["open", "high", "low", "close", "volume"]


@query("describe_bars", sql(" UNION ALL ".join(f"""
    SELECT ticker, '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std,
           {r(f'min({c})', 4)} AS min, {rx(f'quantile_cont({c}, 0.25)', 4)} AS q25, {rx(f'quantile_cont({c}, 0.5)', 4)} AS q50,
           {rx(f'quantile_cont({c}, 0.75)', 4)} AS q75, {r(f'max({c})', 4)} AS max
    FROM bars2 GROUP BY ticker""" for c in _DESCRIBED), "bars2", extra={"bars2": (["bars"], f"""
    SELECT ticker, date, {', '.join(f'{rx(c, 2)} AS {c}' for c in _DESCRIBED[:4])}, CAST(volume AS DOUBLE) AS volume
    FROM bars""")}))
def _(t: Tables):
    out = stats.describe(store.price_rows(t.bars()), _DESCRIBED)
    return rounded(out, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


@query("green_day_ratio", sql("""
    SELECT ticker, CAST(sum(CASE WHEN close > prev THEN 1 ELSE 0 END) AS BIGINT) AS green_days, count(*) AS total_days,
           round(avg(CASE WHEN close > prev THEN 1e0 ELSE 0e0 END), 6) AS green_ratio FROM num GROUP BY ticker""", "num"))
def _(t: Tables):
    return rounded(stats.green_day_ratio(ind.daily_return(t.bars())), 6, "green_ratio")


@query("best_worst_day", sql(f"""
    SELECT ticker, arg_max(date, {{'a': ret, 'b': -epoch(date)}}) AS best_date, round(max(ret), 6) AS best_return,
           arg_min(date, {{'a': ret, 'b': epoch(date)}}) AS worst_date, round(min(ret), 6) AS worst_return
    FROM (SELECT ticker, date, {div('close - prev', 'prev')} * 100 AS ret FROM num) q WHERE ret IS NOT NULL
    GROUP BY ticker""", "num"))
def _(t: Tables):
    return rounded(stats.best_worst_day(ind.daily_return(t.bars())), 6, "best_return", "worst_return")


@query("class_balance", sql(f"""
    SELECT *, CASE WHEN abs(up_rate - 0.5e0) < 0.05e0 THEN 'GOOD' WHEN up_rate > 0.6e0 OR up_rate < 0.4e0
              THEN 'IMBALANCED' ELSE 'ACCEPTABLE' END AS balance
    FROM (SELECT ticker, threshold, count(*) AS n, CAST(sum(up) AS BIGINT) AS up, round(avg(CAST(up AS DOUBLE)), 6) AS up_rate
          FROM (SELECT q.ticker, t.threshold, CASE WHEN {div('future - close', 'close')} > t.threshold THEN 1 ELSE 0 END AS up
                FROM (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS future FROM feat) q,
                     (VALUES (0e0), (0.01e0), (0.02e0)) t(threshold) WHERE future IS NOT NULL) a
          GROUP BY ticker, threshold) b""", "feat"))
def _(t: Tables):
    return rounded(stats.class_balance(t.features()), 6, "up_rate")


@query("atr_stats", sql("""
    SELECT ticker, arg_max(atr, date) AS current_atr, arg_max(atr_pct, date) AS current_atr_pct,
           round(avg(atr), 6) AS avg_atr, max(atr) AS max_atr, arg_max(date, {'a': atr, 'b': -epoch(date)}) AS max_date,
           min(atr) AS min_atr, arg_min(date, {'a': atr, 'b': epoch(date)}) AS min_date
    FROM feat GROUP BY ticker""", "feat"))
def _(t: Tables):
    return rounded(stats.atr_stats(t.features()), 6, "avg_atr")


_SQUEEZE = "SELECT ticker, quantile_cont(bb_width, 0.2) AS width_bound FROM feat GROUP BY ticker"


@query("bb_squeeze_flag", sql(f"""
    SELECT l.ticker, l.date, l.bb_width, {rx('s.width_bound', 5)} AS width_bound, l.bb_width < s.width_bound AS squeeze
    FROM {LAST} l JOIN ({_SQUEEZE}) s ON l.ticker = s.ticker""", "feat"))
def _(t: Tables):
    return rounded(stats.bb_squeeze_flag(t.features()), 5, "width_bound")


_EVENTS_BELOW = f"""
    SELECT ticker, date, {rx('rsi', 1)} AS rsi, close AS entry_price, future AS exit_price,
           {r(div('future - close', 'close') + ' * 100', 2)} AS return_pct, future > close AS recovered
    FROM (SELECT *, lead(close, 10) OVER (PARTITION BY ticker ORDER BY date) AS future FROM feat) q
    WHERE rsi < %d AND future IS NOT NULL"""
_EVENTS = _EVENTS_BELOW % 30


@query("oversold_event_study", sql(_EVENTS, "feat"))
def _(t: Tables):
    return stats.oversold_event_study(t.features(), bound=30)


@query("oversold_event_study_wide", sql(_EVENTS_BELOW % 47, "feat"))
def _(t: Tables):
    return stats.oversold_event_study(t.features(), bound=47)


def _event_summary(events: str) -> str:
    return sql(f"""
    SELECT *, CASE WHEN win_rate > 60 AND mean_return > 0 THEN 'EFFECTIVE' WHEN win_rate > 50 THEN 'MILD' ELSE 'WEAK' END
              AS verdict
    FROM (SELECT ticker, count(*) AS n, round(avg(CASE WHEN recovered THEN 100e0 ELSE 0e0 END), 6) AS win_rate,
                 round(avg(return_pct), 4) AS mean_return, {rx('quantile_cont(return_pct, 0.5)', 4)} AS median_return,
                 max(return_pct) AS best, min(return_pct) AS worst FROM ({events}) e GROUP BY ticker) q""", "feat")


def _summary(t: Tables, bound: int):
    out = stats.event_study_summary(stats.oversold_event_study(t.features(), bound=bound))
    return rounded(rounded(out, 6, "win_rate"), 4, "mean_return", "median_return")


@query("event_study_summary", _event_summary(_EVENTS))
def _(t: Tables):
    return _summary(t, 30)


@query("event_study_summary_wide", _event_summary(_EVENTS_BELOW % 47))
def _(t: Tables):
    return _summary(t, 47)


# ---- latest-bar views ----------------------------------------------------------------------------------

_SIGNALS = f"""SELECT ticker, date, close, rsi, macd_hist, sma_50,
    CASE WHEN close > sma_50 THEN 'Above SMA50' ELSE 'Below SMA50' END AS trend FROM {LAST} l"""
_SIG_OUT = f"ticker, date, close, rsi, {rx('macd_hist', 4)} AS macd_hist, {rx('sma_50', 4)} AS sma_50, trend"


@query("latest_signals", sql(f"SELECT {_SIG_OUT} FROM ({_SIGNALS}) q", "feat"))
def _(t: Tables):
    rows = feat.features(store.price_rows(t.bars()), store.indicator_rows(t.indicators()))
    return rounded(sig.latest_signals(rows), 4, "macd_hist", "sma_50")


@query("market_overview", sql(f"""
    SELECT upper(ticker) AS ticker, strftime(date, '%Y-%m-%d') AS date, close, rsi, {rx('macd_hist', 4)} AS macd_hist,
           {rx('sma_50', 4)} AS sma_50, trend
    FROM ({_SIGNALS}) q WHERE ticker IN (SELECT ticker FROM metadata)""", "feat", "metadata"))
def _(t: Tables):
    return rounded(sig.market_overview(t.features(), t.metadata()), 4, "macd_hist", "sma_50")


@query("overview_badges", sql(f"""
    SELECT ticker, CASE WHEN rsi > 70 THEN '#DC2626' WHEN rsi < 30 THEN '#16A34A' ELSE '#374151' END AS rsi_color,
           macd_hist > 0 AS momentum_up FROM ({_SIGNALS}) q""", "feat"))
def _(t: Tables):
    return sig.overview_badges(sig.latest_signals(t.features())).select("ticker", "rsi_color", "momentum_up")


@query("latest_row", sql(f"SELECT ticker, date, close, rsi FROM {LAST} l", "feat"))
def _(t: Tables):
    return stats.latest_row(t.features()).select("ticker", "date", "close", "rsi")


def _fmt(x: str, d: int) -> str:
    """Fixed decimals of the printed value, rounded half up."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DECIMAL(38,{d})) AS VARCHAR)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _zone(x: str, steps: list) -> str:
    """The ladder as a CASE."""
    *bounded, (_, rest) = steps
    return "CASE " + " ".join(f"WHEN {x} > {float(bound)}e0 THEN {_quoted(text)}" for bound, text in bounded) \
        + f" ELSE {_quoted(rest)} END"


def _side(condition: str, phrases: tuple[str, str]) -> str:
    return f"CASE WHEN {condition} THEN {_quoted(phrases[0])} ELSE {_quoted(phrases[1])} END"


def _filled(template: str, *parts: str) -> str:
    """A printf-like text as a concatenation; numbers are printed by ``_fmt``."""
    pieces, rest = [], iter(parts)
    for literal, kind in re.findall(r"([^%]*)(%%|%\.\df|%s|$)", template):
        pieces.append(_quoted(literal + ("%" if kind == "%%" else "")))
        if kind == "%s":
            pieces.append(next(rest))
        elif kind.endswith("f"):
            pieces.append(_fmt(next(rest), int(kind[2])))
    return " || ".join(p for p in pieces if p != "''")


_ABOVE = ("above", "below")
_RSI_TEXT = _filled(V.RSI_FORMAT, "rsi", _zone("rsi", V.RSI_ZONES))
_MACD_TEXT = _filled(V.MACD_FORMAT, "macd", "macd_signal", _side("macd > macd_signal", V.MACD_SIDES),
                     _side("macd_hist > 0", V.MACD_MOMENTUM))
_BB_TEXT = _filled(V.BAND_FORMAT, "bb_pct", _zone("bb_pct", V.BAND_ZONES), "bb_width", _side("bb_width < 0.05e0", V.BAND_SQUEEZE))
_MA_TEXT = _filled(V.AVERAGE_FORMAT, "close", _side("close > sma_20", _ABOVE), "sma_20", _side("close > sma_50", _ABOVE),
                   "sma_50", _side("sma_20 > sma_50", V.AVERAGE_CROSS))
_VOLUME_TEXT = _filled(V.VOLUME_FORMAT, "volume_ratio", _zone("volume_ratio", V.VOLUME_ZONES))
_ATR_TEXT = _filled(V.ATR_FORMAT, "atr", "atr_pct", _zone("atr_pct", V.VOLATILITY_ZONES), "atr")
_VOTES = """(CASE WHEN rsi >= 50 THEN 1 ELSE 0 END + CASE WHEN macd > macd_signal THEN 1 ELSE 0 END
    + CASE WHEN close > sma_50 THEN 1 ELSE 0 END + CASE WHEN bb_pct >= 0.5e0 THEN 1 ELSE 0 END)"""
_CARD_VOTES = """(CASE WHEN rsi < 50 THEN 1 ELSE 0 END + CASE WHEN macd > macd_signal THEN 1 ELSE 0 END
    + CASE WHEN close > sma_50 THEN 1 ELSE 0 END + CASE WHEN bb_pct > 0.5e0 THEN 1 ELSE 0 END)"""


def _text(name: str, expression: str, column) -> None:
    """Register a text bucket over every feature row."""
    @query(name, sql(f"SELECT ticker, date, {expression} AS {name} FROM feat", "feat"))
    def _(t: Tables):
        return t.features().select("ticker", "date", column().alias(name))


_text("rsi_text", _RSI_TEXT, lambda: S.rsi_text(F.col("rsi")))
_text("macd_text", _MACD_TEXT, lambda: S.macd_text(F.col("macd"), F.col("macd_signal"), F.col("macd_hist")))
_text("bb_text", _BB_TEXT, lambda: S.bb_text(F.col("bb_pct"), F.col("bb_width")))
_text("ma_text", _MA_TEXT, lambda: S.ma_text(F.col("close"), F.col("sma_20"), F.col("sma_50")))
_text("volume_text", _VOLUME_TEXT, lambda: S.volume_text(F.col("volume_ratio")))
_text("atr_text", _ATR_TEXT, lambda: S.atr_text(F.col("atr"), F.col("atr_pct")))
_text("indicator_tooltip", f"'RSI is currently ' || {_fmt('rsi', 2)} || '.'",
      lambda: S.indicator_tooltip(F.lit("RSI"), F.col("rsi")))
_BIAS = "CASE WHEN bullish > 2 THEN 'BULLISH BIAS' WHEN bullish < 2 THEN 'BEARISH BIAS' ELSE 'NEUTRAL' END AS bias"


@query("bias_vote", sql(f"""
    SELECT ticker, date, bullish, 4 - bullish AS bearish, {_BIAS} FROM (SELECT *, {_VOTES} AS bullish FROM feat) q""", "feat"))
def _(t: Tables):
    return sig.bias_vote(t.features()).select("ticker", "date", "bullish", "bearish", "bias")


@query("interpret_last_bar", sql(f"""
    SELECT ticker, date, {_MA_TEXT} AS ma_text, {_RSI_TEXT} AS rsi_text, {_MACD_TEXT} AS macd_text, {_BB_TEXT} AS bb_text,
           {_VOLUME_TEXT} AS volume_text, {_ATR_TEXT} AS atr_text, bullish, 4 - bullish AS bearish, {_BIAS}
    FROM (SELECT *, {_VOTES} AS bullish FROM {LAST} l) q""", "feat"))
def _(t: Tables):
    return sig.interpret_last_bar(t.features())


@query("signal_card", sql(f"""
    SELECT ticker, date, close, CASE WHEN rsi > 70 THEN 'OVERBOUGHT' WHEN rsi < 30 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS rsi_label,
           CASE WHEN macd > macd_signal THEN 'BULLISH' ELSE 'BEARISH' END AS macd_label,
           CASE WHEN macd_hist > 0 THEN 'accelerating' ELSE 'decelerating' END AS momentum,
           CASE WHEN close > sma_50 THEN 'UPTREND' ELSE 'DOWNTREND' END AS trend_label,
           {r(div('close - sma_50', 'sma_50') + ' * 100', 6)} AS sma50_diff,
           CASE WHEN bb_pct > 0.8e0 THEN 'UPPER BAND' WHEN bb_pct < 0.2e0 THEN 'LOWER BAND' ELSE 'MIDDLE' END AS bb_label,
           bb_width < width_bound AS squeeze, CASE WHEN atr_pct > 2 THEN 'HIGH' ELSE 'NORMAL' END AS volatility,
           bullish, 4 - bullish AS bearish,
           CASE WHEN bullish > 2 THEN 'BULLISH' WHEN bullish < 2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias
    FROM (SELECT l.*, s.width_bound, {_CARD_VOTES} AS bullish FROM {LAST} l JOIN ({_SQUEEZE}) s ON l.ticker = s.ticker) q""", "feat"))
def _(t: Tables):
    return rounded(sig.signal_card(t.features()), 6, "sma50_diff")


# ---- splits and windows --------------------------------------------------------------------------------

_SPLIT = "CAST(floor(n_rows * 0.8e0) AS BIGINT)"


@query("chronological_split", sql(f"""
    SELECT ticker, date, CASE WHEN pos < {_SPLIT} THEN 'train' ELSE 'test' END AS split FROM placed""", "placed"))
def _(t: Tables):
    return feat.chronological_split(t.dataset()).select("ticker", "date", "split")


@query("calibration_slice", sql(f"""
    SELECT ticker, date FROM placed
    WHERE pos < {_SPLIT} AND pos >= {_SPLIT} - CAST(floor({_SPLIT} * 0.2e0) AS BIGINT)""", "placed"))
def _(t: Tables):
    return feat.calibration_slice(t.dataset()).select("ticker", "date")


@query("expanding_folds", sql("""
    SELECT ticker, f.fold, min(pos) AS n_train, count(*) AS n_val, min(date) AS val_start, max(date) AS val_end
    FROM placed, (VALUES (1), (2), (3)) f(fold)
    WHERE pos >= n_rows - (4 - f.fold) * (n_rows // 4) AND pos < n_rows - (3 - f.fold) * (n_rows // 4)
    GROUP BY ticker, f.fold""", "placed"))
def _(t: Tables):
    return feat.expanding_folds(t.dataset())


@query("walkforward_windows", sql("""
    SELECT ticker, win AS "window", min(train_size) AS train_size, min(date) AS test_start, max(date) AS test_end,
           count(*) AS test_size, round(avg(label), 6) AS up_rate FROM windows GROUP BY ticker, win""", "windows"))
def _(t: Tables):
    return rounded(feat.walkforward_windows(t.dataset()), 6, "up_rate")


# ---- metrics on deterministic scores -------------------------------------------------------------------


@query("roc_auc", sql("SELECT ticker, round(roc_auc, 6) AS roc_auc FROM auc", "auc",
                      extra=auc_ctes("scores", ["ticker"], ["scores"])))
def _(t: Tables):
    return rounded(metrics.roc_auc(t.scores(), ["ticker"]), 6, "roc_auc")


_ACC = "avg(CASE WHEN pred = actual THEN 1e0 ELSE 0e0 END)"


@query("accuracy", sql(f"SELECT ticker, {r(_ACC, 6)} AS accuracy FROM scores GROUP BY ticker", "scores"))
def _(t: Tables):
    return rounded(metrics.accuracy(t.scores(), ["ticker"]), 6, "accuracy")


_CELLS = ", ".join(f"CAST(sum(CASE WHEN actual = {a} AND pred = {p} THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
                   for n, a, p in [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)])


@query("confusion_matrix", sql(f"SELECT ticker, {_CELLS} FROM scores GROUP BY ticker", "scores"))
def _(t: Tables):
    return metrics.confusion_matrix(t.scores(), ["ticker"])


def _report(name: str, hit: str, wrong: str, missed: str) -> str:
    def part(a: str, b: str) -> str:
        return f"round(coalesce({div(a, b)}, 0e0), 6)"
    return f"""SELECT ticker, '{name}' AS class, {part(hit, f'{hit} + {wrong}')} AS "precision",
        {part(hit, f'{hit} + {missed}')} AS recall, {part(f'2 * {hit}', f'2 * {hit} + {wrong} + {missed}')} AS f1,
        {hit} + {missed} AS support FROM cells"""


@query("classification_report", sql(
    f"{_report('DOWN', 'tn', 'fn', 'fp')} UNION ALL {_report('UP', 'tp', 'fp', 'fn')}", "cells",
    extra={"cells": (["scores"], f"SELECT ticker, {_CELLS} FROM scores GROUP BY ticker")}))
def _(t: Tables):
    return rounded(metrics.classification_report(t.scores(), ["ticker"]), 6, "precision", "recall", "f1")


@query("baselines", sql(f"""
    SELECT ticker, majority_class, round(up, 6) AS always_up, round(1 - up, 6) AS always_down,
           round(CASE WHEN majority_class = 1 THEN up ELSE 1 - up END, 6) AS majority
    FROM (SELECT ticker, avg(CASE WHEN pos >= {_SPLIT} THEN label END) AS up,
                 CASE WHEN avg(CASE WHEN pos < {_SPLIT} THEN label END) > 0.5e0 THEN 1 ELSE 0 END AS majority_class
          FROM placed GROUP BY ticker) q""", "placed"))
def _(t: Tables):
    return rounded(metrics.baselines(feat.chronological_split(t.dataset())), 6, "always_up", "always_down", "majority")


@query("calibration_curve", sql("""
    SELECT ticker, CAST(greatest(ceil(prob * 8) - 1, 0) AS INTEGER) AS bin, round(avg(prob), 6) AS mean_prob,
           round(avg(actual), 6) AS fraction_positive FROM scores GROUP BY ALL""", "scores"))
def _(t: Tables):
    return rounded(metrics.calibration_curve(t.scores(), ["ticker"]), 6, "mean_prob", "fraction_positive")


# ---- regimes -------------------------------------------------------------------------------------------


@query("regime", sql("SELECT ticker, date, regime FROM regimes", "regimes"))
def _(t: Tables):
    return metrics.market_regime(t.bars()).select("ticker", "date", "regime")


@query("regime_asof", sql(f"""
    SELECT s.ticker, s.date, {rx("s.prob", 6)} AS prob, g.regime
    FROM (SELECT ticker, CAST(date + INTERVAL 2 DAY AS DATE) AS date, prob FROM scores) s
    ASOF LEFT JOIN regimes g ON s.ticker = g.ticker AND s.date >= g.date""", "scores", "regimes"))
def _(t: Tables):
    # Regimes exist for trading days; predictions are shifted two days so that many fall between them.
    shifted = t.scores().withColumn("date", F.date_add("date", 2))
    return rounded(metrics.regime_asof(shifted, metrics.market_regime(t.bars())), 6, "prob").select(
        "ticker", "date", "prob", "regime")


_PERF = {
    **auc_ctes("known", ["ticker", "regime"], ["known"], "regime_auc"),
    "known": (["with_regime"], "SELECT * FROM with_regime WHERE regime IN ('bull', 'bear')"),
    "perf": (["known", "regime_auc"], f"""
        SELECT k.*, a.roc_auc FROM (SELECT ticker, regime, count(*) AS days, {_ACC} AS accuracy, avg(actual) AS up_rate
                                    FROM known GROUP BY ticker, regime HAVING count(*) >= 10) k
        JOIN regime_auc a ON a.ticker = k.ticker AND a.regime = k.regime"""),
}


@query("regime_performance", sql("""
    SELECT ticker, regime, days, round(accuracy, 6) AS accuracy, round(up_rate, 6) AS up_rate, round(roc_auc, 6) AS roc_auc
    FROM perf""", "perf", extra=_PERF))
def _(t: Tables):
    out = metrics.regime_performance(t.scores(), metrics.market_regime(t.bars()))
    return rounded(out, 6, "accuracy", "up_rate", "roc_auc")


@query("regime_verdict", sql("""
    SELECT ticker, round(bull, 6) AS bull_auc, round(bear, 6) AS bear_auc,
           CASE WHEN abs(bull - bear) < 0.05e0 THEN 'CONSISTENT' WHEN bull > bear THEN 'BETTER IN BULL'
                ELSE 'BETTER IN BEAR' END AS verdict
    FROM (SELECT ticker, max(CASE WHEN regime = 'bull' THEN roc_auc END) AS bull,
                 max(CASE WHEN regime = 'bear' THEN roc_auc END) AS bear FROM perf GROUP BY ticker) q
    WHERE bull - bear IS NOT NULL""", "perf", extra=_PERF))
def _(t: Tables):
    perf = metrics.regime_performance(t.scores(), metrics.market_regime(t.bars()))
    return rounded(metrics.regime_verdict(perf), 6, "bull_auc", "bear_auc")


_WINDOW_SCORES = {
    "wscores": (["windows"], """
        SELECT ticker, date, win, train_size, 1 - rsi/100 AS prob, label AS actual,
               CASE WHEN 1 - rsi/100 > 0.5e0 THEN 1 ELSE 0 END AS pred FROM windows"""),
    **auc_ctes("wscores", ["ticker", "win"], ["wscores"], "wauc"),
}


@query("walkforward_summary", sql("""
    SELECT ticker, count(*) AS windows, round(avg(a), 9) AS mean_auc, round(stddev_samp(a), 9) AS std_auc,
           min(a) AS min_auc, max(a) AS max_auc, CAST(sum(CASE WHEN a > 0.55e0 THEN 1 ELSE 0 END) AS BIGINT) AS good_windows
    FROM (SELECT ticker, """ + rx("roc_auc", 4) + """ AS a FROM wauc) q GROUP BY ticker""", "wauc", extra=_WINDOW_SCORES))
def _(t: Tables):
    rows = feat.with_windows(t.dataset()).filter("window is not null")
    prob = 1 - F.col("rsi") / 100
    scored = rows.select("ticker", "date", "window", "train_size", prob.alias("prob"), F.col("label").alias("actual"),
                         (prob > 0.5).cast("int").alias("pred"))
    # Nine places: a mean of 32 four-place values is an exact tie at the sixth.
    return rounded(metrics.walkforward_summary(metrics.window_results(scored)), 9, "mean_auc", "std_auc")


# ---- strategy and risk ---------------------------------------------------------------------------------

_EQUITY = equity_ctes([0.55], 0.001, "returns", ["returns"])
_SWEEP = equity_ctes(STRATEGY_THRESHOLDS, 0.001, "returns", ["returns"])
_RISK = ["total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor", "n_trades",
         "days_invested", "bh_total_return", "bh_annual_return"]


def _returns(t: Tables):
    return strategy.prediction_returns(t.scores(), store.price_rows(t.bars()))


@query("price_at_prediction", sql("SELECT ticker, date, price FROM returns", "returns"))
def _(t: Tables):
    return strategy.price_at_prediction(t.scores(), store.price_rows(t.bars())).select("ticker", "date", "price")


@query("strategy_equity", sql("""
    SELECT ticker, date, position, round(sret, 6) AS strategy_return, round(cum_strategy, 6) AS cum_strategy,
           round(cum_buyhold, 6) AS cum_buyhold FROM equity""", "equity", extra=_EQUITY))
def _(t: Tables):
    out = strategy.strategy_equity(_returns(t))
    return rounded(out, 6, "strategy_return", "cum_strategy", "cum_buyhold").select(
        "ticker", "date", "position", "strategy_return", "cum_strategy", "cum_buyhold")


@query("drawdown_series", sql("SELECT ticker, date, round(drawdown, 6) AS drawdown FROM equity", "equity", extra=_EQUITY))
def _(t: Tables):
    return rounded(strategy.strategy_equity(_returns(t)), 6, "drawdown").select("ticker", "date", "drawdown")


@query("risk_metrics", sql(f"SELECT ticker, threshold, {', '.join(_RISK)} FROM risk", "risk", extra=_EQUITY))
def _(t: Tables):
    return strategy.risk_metrics(strategy.strategy_equity(_returns(t)))


@query("threshold_sweep", sql(f"SELECT ticker, threshold, {', '.join(_RISK)} FROM risk", "risk", extra=_SWEEP))
def _(t: Tables):
    return strategy.risk_metrics(strategy.strategy_equity(_returns(t), STRATEGY_THRESHOLDS))


@query("best_threshold", sql(f"""
    SELECT ticker, threshold, {', '.join(_RISK)} FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sharpe_ratio DESC, threshold) AS k FROM risk) q
    WHERE k = 1""", "risk", extra=_SWEEP))
def _(t: Tables):
    return strategy.best_threshold(strategy.risk_metrics(strategy.strategy_equity(_returns(t), STRATEGY_THRESHOLDS)))


@query("alpha", sql("SELECT ticker, round(annual_return - bh_annual_return, 4) AS alpha FROM risk", "risk", extra=_EQUITY))
def _(t: Tables):
    out = strategy.alpha(strategy.risk_metrics(strategy.strategy_equity(_returns(t))))
    return rounded(out, 4, "alpha").select("ticker", "alpha")


@query("simple_equity", sql("""
    SELECT ticker, date, position, round(cum_strategy, 6) AS cum_strategy, round(cum_buyhold, 6) AS cum_buyhold FROM equity""",
    "equity", extra=equity_ctes([0.55], 0.0, "full_returns", ["full_returns"]) | {
        "full_returns": (["scores", "placed", "num"], f"""
            SELECT s.*, s.prob AS prev_prob, coalesce({div('a.c - a.p', 'a.p')}, 0e0) AS ret
            FROM scores s JOIN placed p ON s.ticker = p.ticker AND s.date = p.date AND p.pos >= {_SPLIT}
            JOIN (SELECT ticker, date, {rx('close', 2)} AS c, {rx('prev', 2)} AS p FROM num) a
              ON s.ticker = a.ticker AND s.date = a.date""")}))
def _(t: Tables):
    test = feat.chronological_split(t.dataset()).filter("split = 'test'").select(
        "ticker", "date", (1 - F.col("rsi") / 100).alias("prob"))
    out = strategy.strategy_equity(strategy.full_series_returns(test, store.price_rows(t.bars())), cost=0.0)
    return rounded(out, 6, "cum_strategy", "cum_buyhold").select("ticker", "date", "position", "cum_strategy", "cum_buyhold")
