import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.operators import indicators as ind
from tapewise.operators import averages, panel
from tests.conftest import walk


def by_ticker(pdf, fn):
    parts = [fn(g.sort_values("date").reset_index(drop=True)) for _, g in pdf.groupby("ticker")]
    return pd.concat(parts, ignore_index=True).sort_values(["ticker", "date"]).reset_index(drop=True)


def collected(df):
    return df.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


def ewm(s, n):
    return s.ewm(span=n, adjust=False).mean()


def reference(g):
    c, out = g["close"], g[["ticker", "date"]].copy()
    out["sma_20"], out["sma_50"], out["ema_20"] = c.rolling(20).mean(), c.rolling(50).mean(), ewm(c, 20)
    out["macd"] = ewm(c, 12) - ewm(c, 26)
    out["macd_signal"] = ewm(out["macd"], 9)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    change = c.diff()
    gain, loss = (s.clip(lower=0).ewm(com=13, min_periods=14, adjust=False).mean() for s in (change, -change))
    out["rsi"] = 100 - 100 / (1 + gain / (loss + 1e-10))
    std = c.rolling(20).std()
    out["bb_upper"], out["bb_lower"] = out["sma_20"] + 2 * std, out["sma_20"] - 2 * std
    width = out["bb_upper"] - out["bb_lower"]
    out["bb_width"], out["bb_pct"] = width / out["sma_20"], (c - out["bb_lower"]) / width
    out["volume_ratio"] = g["volume"] / g["volume"].rolling(20).mean()
    prev = c.shift(1)
    tr = pd.concat([g["high"] - g["low"], (g["high"] - prev).abs(), (g["low"] - prev).abs()], axis=1).max(axis=1)
    out["atr"] = ewm(tr, 14).round(2)
    return out


COLUMNS = ["sma_20", "sma_50", "ema_20", "macd", "macd_signal", "macd_hist", "rsi", "bb_upper", "bb_lower",
           "bb_width", "bb_pct", "volume_ratio", "atr"]


def same(got, want, columns, rtol=1e-9):
    for c in columns:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        np.testing.assert_allclose(a, b, rtol=rtol, atol=1e-9, equal_nan=True, err_msg=c)


def test_all_indicators_across_blocks(bars, panel_pd, small_blocks):
    got, want = collected(ind.indicators_all(bars, complete_only=False)), by_ticker(panel_pd, reference)
    moving = got["ticker"] != "FLAT"  # 0/0 in a flat window: null here, noise in pandas
    same(got[moving].reset_index(drop=True), want[moving].reset_index(drop=True), COLUMNS)


def test_single_operators_match_the_fused_pass(bars, panel_pd, small_blocks):
    want = by_ticker(panel_pd, reference)
    moving = (want["ticker"] != "FLAT").to_numpy()
    for df, columns in [(ind.sma(bars, 20), ["sma_20"]), (ind.ema(bars, 20), ["ema_20"]), (ind.rsi(bars), ["rsi"]),
                        (ind.macd(bars), COLUMNS[3:6]), (ind.bollinger(bars), COLUMNS[7:11]),
                        (ind.atr(bars), ["atr"]), (ind.volume_ratio(bars), ["volume_ratio"]),
                        (ind.moving_averages(bars), COLUMNS[:3])]:
        same(collected(df)[moving], want[moving], columns)


@pytest.mark.parametrize("span", [2, 9, 50, 200])
def test_ema_of_any_span(bars, panel_pd, small_blocks, span):
    got = collected(ind.ema(bars, span, name="e"))
    want = by_ticker(panel_pd, lambda g: g[["ticker", "date"]].assign(e=ewm(g["close"], span)))
    same(got, want, ["e"])


def test_complete_rows_start_at_row_49_and_flat_rows_are_dropped(bars, panel_pd):
    got = collected(ind.indicators_all(bars))
    assert got.groupby("ticker").size().to_dict() == {"HOT": 2951, "MID": 1451, "T60": 11}


def test_flat_series(bars):
    got = collected(ind.rsi(bars).join(ind.bollinger(bars).select("ticker", "date", "bb_width", "bb_pct"), ["ticker", "date"])
                    .filter("ticker = 'FLAT' and pos >= 20"))
    assert (got["rsi"] == 0).all() and (got["bb_width"].abs() < 1e-12).all() and got["bb_pct"].isna().all()


def test_bounds(bars):
    got = collected(ind.indicators_all(bars))
    assert got["rsi"].between(0, 100).all() and (got["bb_lower"] <= got["bb_upper"]).all()
    assert np.allclose(got["macd_hist"], got["macd"] - got["macd_signal"])


def test_crossovers(bars, panel_pd, small_blocks):
    def fn(g):
        r = reference(g)
        ma = pd.Series(np.where(r["sma_20"] > r["sma_50"], 1, -1))
        up = (r["macd"] > r["macd_signal"]).astype(int)
        return r[["ticker", "date"]].assign(ma_position=ma, ma_signal=ma.diff(), macd_cross=up.diff())

    want = by_ticker(panel_pd, fn)
    same(collected(ind.sma_crossover(bars)), want, ["ma_position", "ma_signal"])
    keep = (want["ticker"] != "FLAT").to_numpy()
    same(collected(ind.macd_crossover(bars))[keep], want[keep], ["macd_cross"])


def test_numbering_and_blocks(bars, panel_pd):
    want = by_ticker(panel_pd, lambda g: g[["ticker", "date"]].assign(pos=np.arange(len(g)), n_rows=len(g)))
    same(collected(panel.numbered(bars)), want, ["pos", "n_rows"])
    cut = panel.with_halo(bars, back=60, ahead=10, block=160)
    sizes = cut.df.groupBy("ticker", "_block").agg(F.count("*").alias("n"), F.max(F.col("_home").cast("int")).alias("h")).toPandas()
    assert sizes["n"].max() <= 160 + 60 + 10 + 4 * panel.UNIT_ROWS  # no task ever sees a whole long ticker
    assert len(sizes[sizes["ticker"] == "HOT"]) >= 18
    same(collected(cut.done()), want, ["pos", "n_rows"])


def test_block_too_long_for_a_decay_is_refused(bars):
    carry = averages.Carry({"e": ("close", 2 / 3)})
    with pytest.raises(ValueError):
        panel.with_halo(bars, back=50, block=100_000, carry=carry).decay({"e": ("close", 2 / 3, "close")})


@pytest.fixture(scope="module")
def gaps_pd(panel_pd):
    """Unknown prices on the first rows, inside, in a row, and at the edges of blocks of any length."""
    out = panel_pd[panel_pd["ticker"].isin(["HOT", "MID", "T60", "T49"])].copy()
    at = out.groupby("ticker").cumcount()
    rng = np.random.default_rng(8)
    close = (at < 2) & (out["ticker"] != "MID") | (at % 64 == 0) | (at % 64 == 63) & (out["ticker"] == "HOT") | at.between(700, 715) | (rng.random(len(out)) < 0.05)
    out.loc[close, "close"] = np.nan
    out.loc[at.isin([0, 5, 6, 7, 127, 128, 129]) | (rng.random(len(out)) < 0.05), ["high", "low"]] = np.nan
    return out


def test_exponential_averages_with_unknown_values(spark, gaps_pd, small_blocks):
    rows = spark.createDataFrame(gaps_pd).replace(float("nan"), None)
    want = by_ticker(gaps_pd, reference)
    for df, columns in [(ind.ema(rows, 20), ["ema_20"]), (ind.rsi(rows), ["rsi"]), (ind.macd(rows), COLUMNS[3:6]), (ind.atr(rows), ["atr"]),
                        (ind.indicators_all(rows, complete_only=False), ["ema_20", "macd", "macd_signal", "macd_hist", "rsi", "atr"])]:
        same(collected(df), want, columns, rtol=1e-8)
    assert collected(ind.ema(spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": pd.to_datetime(["2020-01-01", "2020-01-02", "2020-01-03"]).date,
                     "close": [1.0, None, 3.0]})).replace(float("nan"), None), 3, name="e"))["e"].round(2).tolist() == [1.0, 1.0, 2.33]


@pytest.mark.parametrize("n", [3_000, 30_000])
def test_averages_across_gaps_of_any_length(spark, n):
    """Nine of ten prices unknown, and none for long stretches, in tickers of one block and of many."""
    out = pd.concat([walk("A", n, 11, gap=0), walk("B", n // 2, 12, gap=0)], ignore_index=True)
    rng, at = np.random.default_rng(4), out.groupby("ticker").cumcount()
    out.loc[(rng.random(len(out)) < 0.9) & ~at.between(n // 3, n // 3 + 40) | at.between(n // 2, n // 2 + n // 4), "close"] = np.nan
    out.loc[rng.random(len(out)) < 0.9, ["high", "low"]] = np.nan
    rows, want = spark.createDataFrame(out).replace(float("nan"), None), by_ticker(out, reference)
    averages = ["ema_20", "macd", "macd_signal", "macd_hist", "rsi", "atr"]
    same(collected(ind.indicators_all(rows, complete_only=False)), want, averages, rtol=1e-8)
    for df, columns in [(ind.ema(rows, 20), averages[:1]), (ind.rsi(rows), ["rsi"]), (ind.macd(rows), averages[1:4]), (ind.atr(rows), ["atr"])]:
        same(collected(df), want, columns, rtol=1e-8)


def test_nan_is_an_unknown_value(spark, panel_pd, small_blocks):
    out = panel_pd[panel_pd["ticker"] == "MID"].copy()
    out.loc[out.index[::3], "close"] = np.nan
    same(collected(ind.ema(spark.createDataFrame(out), 20)), by_ticker(out, reference), ["ema_20"])


def test_future_bars_do_not_change_the_past(spark, bars, panel_pd):
    cut = panel_pd[panel_pd["ticker"] == "MID"].sort_values("date")
    changed = cut.copy()
    changed.loc[changed.index[1000:], ["open", "high", "low", "close"]] *= 3
    before, after = (collected(ind.indicators_all(spark.createDataFrame(x), complete_only=False)) for x in (cut, changed))
    same(before[:1000], after[:1000], COLUMNS, rtol=1e-12)
    assert not np.allclose(before["sma_20"][1100:], after["sma_20"][1100:])


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_no_exchange_by_ticker_alone_feeds_row_windows(bars):
    spread = bars.repartition("ticker")  # as left behind by a join on ticker
    assert any("hashpartitioning(ticker" in e and "_block" in e for e in exchanges(panel.with_halo(spread, back=5).done()))
    assert any("hashpartitioning(ticker" in e and "_unit" in e for e in exchanges(panel.numbered(spread)))


def test_indicators_use_one_exchange_and_one_sort_for_all_windows(bars):
    plan = ind.indicators_all(bars)._jdf.queryExecution().executedPlan().toString()
    blocks = [line for line in plan.splitlines() if "_block" in line]
    assert sum("Exchange hashpartitioning" in line for line in blocks) == 1
    assert sum("Sort [" in line for line in blocks) == 1
    assert sum("Window [" in line for line in blocks) <= 10  # stages that build on each other, over the same sorted rows
