import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.operators import features as feat
from tapewise.operators import metrics, sentiment, stats, strategy
from tests.test_panel import by_ticker, collected, same


@pytest.fixture(scope="module")
def closes(bars):
    return bars.select("ticker", "date", "close").cache()


def test_forward_labels(closes, panel_pd, small_blocks):
    def fn(g):
        future = g["close"].shift(-10)
        return g[["ticker", "date"]].assign(label=((future - g["close"]) / g["close"] > 0).astype(int))[:-10]

    want = by_ticker(panel_pd, fn)
    same(collected(feat.forward_label(closes, 10)), want, ["label"])
    wide = collected(feat.forward_labels(closes, [1, 10])).dropna(subset=["label_10"]).reset_index(drop=True)
    same(wide.rename(columns={"label_10": "label"}), want, ["label"])
    with pytest.raises(ValueError):
        feat.forward_label(closes, 0)


def test_splits_folds_and_windows(closes, panel_pd):
    rows = closes.withColumn("label", F.lit(1)).filter("ticker in ('HOT', 'MID', 'T60')")
    split = collected(feat.chronological_split(rows))
    for ticker, g in split.groupby("ticker"):
        n = len(g)
        assert list(g["split"]) == ["train"] * int(n * 0.8) + ["test"] * (n - int(n * 0.8)), ticker
    cal = collected(feat.calibration_slice(rows)).groupby("ticker").size()
    assert cal["HOT"] == int(2400 * 0.2) and cal["T60"] == int(48 * 0.2)
    folds = feat.expanding_folds(rows).toPandas().set_index(["ticker", "fold"])
    assert list(folds.loc["MID"]["n_train"].sort_index()) == [375, 750, 1125] and set(folds.loc["MID"]["n_val"]) == {375}
    windows = feat.walkforward_windows(rows).toPandas()
    for ticker, n in (("HOT", 3000), ("MID", 1500)):
        got = windows[windows["ticker"] == ticker].sort_values("window")
        starts = list(range(n // 2, n, 21))
        assert list(got["train_size"]) == starts and list(got["window"]) == list(range(len(starts)))
        assert list(got["test_size"]) == [min(21, n - s) for s in starts]
    assert "T60" not in set(windows["ticker"])  # never reaches 150 training rows
    late = feat.with_windows(rows, min_train=1600).filter("ticker = 'HOT' and window = 0").toPandas()
    assert late["train_size"].iloc[0] == 1605  # first block start of at least 1600


def test_training_rows_precede_test_rows(closes):
    rows = feat.with_windows(closes.withColumn("label", F.lit(1))).filter("window is not null").toPandas()
    assert (rows["pos"] >= rows["train_size"]).all()


def test_min_history(closes):
    assert {r[0] for r in feat.min_history(closes, 60).select("ticker").distinct().collect()} == {"HOT", "MID", "T60", "FLAT"}


def test_quantiles_match_numpy(bars, panel_pd):
    got = stats.quantiles(bars, ["ticker"], ["close", "volume"], [0.2, 0.5, 0.75]).toPandas()
    assert len(got) == 6 * 2 * 3
    for r in got.itertuples():
        values = panel_pd[panel_pd["ticker"] == r.ticker][r.column]
        assert np.isclose(r.quantile, np.quantile(values, r.p), rtol=1e-12), r


def test_describe(bars, panel_pd):
    got = stats.describe(bars, ["close"]).toPandas().set_index("ticker")
    want = panel_pd[panel_pd["ticker"] == "HOT"]["close"].describe()
    for a, b in zip(["count", "mean", "std", "min", "q25", "q50", "q75", "max"], want):
        assert np.isclose(got.loc["HOT", a], b)


def test_roc_auc_with_ties_equals_pairs(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.where(np.arange(400) < 300, "a", "b"), "prob": np.round(rng.random(400), 2),
                        "actual": rng.integers(0, 2, 400)})
    one = pd.DataFrame({"g": "c", "prob": [0.1, 0.9], "actual": [1, 1]})
    got = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(spark.createDataFrame(pd.concat([pdf, one])), ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        p, q = part[part.actual == 1].prob.to_numpy(), part[part.actual == 0].prob.to_numpy()
        pairs = (p[:, None] > q).mean() + (p[:, None] == q).mean() / 2
        assert np.isclose(got[g], pairs)
    assert got["c"] == 0.5


def test_regimes(closes, panel_pd, small_blocks):
    def fn(g):
        avg = g["close"].rolling(200).mean()
        regime = pd.Series(np.where(g["close"] > avg, "bull", "bear"))
        regime[:200] = "unknown"
        return g[["ticker", "date"]].assign(regime=regime)

    want = by_ticker(panel_pd, fn)
    regimes = metrics.market_regime(closes).cache()
    got = collected(regimes)
    assert got[got["regime"] != want["regime"]].empty, (got[got["regime"] != want["regime"]], want[got["regime"] != want["regime"]])
    dates = pd.DataFrame({"ticker": "HOT", "date": [dt.date(1989, 1, 1)] + [dt.date(1990, 1, 1) + dt.timedelta(days=7 * i) for i in range(400)],
                          "prob": 0.6, "actual": 1, "pred": 1})
    predictions = closes.sparkSession.createDataFrame(dates)
    asof = collected(metrics.regime_asof(predictions, regimes))
    hot = want[want["ticker"] == "HOT"]
    merged = pd.merge_asof(dates.assign(date=pd.to_datetime(dates["date"])),
                           hot.assign(date=pd.to_datetime(hot["date"]))[["date", "regime"]], on="date")
    assert list(asof["regime"].fillna("-")) == list(merged["regime"].fillna("-"))
    assert metrics.regime_performance(predictions.limit(5), regimes).count() == 0  # fewer than ten rows


def test_sentiment_windows(spark, closes, panel_pd, small_blocks):
    rng = np.random.default_rng(3)
    dates = panel_pd[panel_pd["ticker"].isin(["HOT", "T60"])].groupby("ticker").apply(
        lambda g: g.sort_values("date")["date"].iloc[5:].sample(frac=0.2, random_state=1), include_groups=False)
    news = dates.reset_index(level=0).reset_index(drop=True)
    news = pd.concat([news, news.sample(frac=0.5, random_state=2)], ignore_index=True)
    news["sentiment_score"] = rng.uniform(-1, 1, len(news)).round(1)  # no ties at the fourth decimal
    got = collected(sentiment.sentiment_windows(closes, sentiment.daily_sentiment(spark.createDataFrame(news))))

    def fn(g):
        mine = news[news["ticker"] == g["ticker"].iloc[0]].groupby("date")["sentiment_score"].mean().round(4)
        a = g["date"].map(mine).ffill().bfill().fillna(0)
        out = g[["ticker", "date"]].assign(**{f"sentiment_{n}d": a.rolling(n, min_periods=1).mean().round(4) for n in (1, 3, 7)})
        return out.assign(sentiment_momentum=(out["sentiment_1d"] - out["sentiment_7d"]).round(4))

    want = by_ticker(panel_pd, fn)
    same(got, want, ["sentiment_1d", "sentiment_3d", "sentiment_7d", "sentiment_momentum"])
    assert (got[got["ticker"] == "MID"]["sentiment_7d"] == 0).all()  # no news at all
    head = collected(sentiment.ffill_bfill(sentiment.calendar_align(closes, sentiment.daily_sentiment(spark.createDataFrame(news))), backfill=False))
    assert (head[head["ticker"] == "HOT"]["sentiment"].iloc[:5] == 0).all()


def test_unknown_aggregation_is_an_error(spark):
    with pytest.raises(ValueError):
        sentiment.daily_sentiment(spark.createDataFrame([], "ticker string, date date, sentiment_score double"), "median")


def test_weighted_day_without_weight_is_missing(spark):
    news = spark.createDataFrame([("A", dt.date(2020, 1, 1), 0.0)], "ticker string, date date, sentiment_score double")
    assert sentiment.daily_sentiment(news, "weighted").first()["sentiment"] is None


def test_lagged_positions_never_see_the_day_they_earn(spark, closes, panel_pd):
    hot = panel_pd[panel_pd["ticker"] == "HOT"].sort_values("date").iloc[:400]
    probs = np.random.default_rng(6).random(len(hot))
    rows = strategy.prediction_returns(spark.createDataFrame(hot[["ticker", "date"]].assign(prob=probs)), closes)
    got = collected(strategy.strategy_equity(rows, [0.6], lag_position=True))
    pos = np.r_[0.0, probs[:-1] > 0.6]
    np.testing.assert_array_equal(got["position"], pos)
    np.testing.assert_array_equal(got["change"], np.r_[0.0, 0.0, np.abs(np.diff(pos))[1:]])


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_strategy_matches_numpy(spark, closes, panel_pd, threshold):
    hot = panel_pd[panel_pd["ticker"] == "HOT"].sort_values("date").iloc[100:1500]
    probs = np.random.default_rng(5).random(len(hot))
    pdf = hot[["ticker", "date"]].assign(prob=probs)
    equity = strategy.strategy_equity(strategy.prediction_returns(spark.createDataFrame(pdf), closes), [threshold])
    got = collected(equity)
    r = hot["close"].pct_change().fillna(0).to_numpy()
    pos = (probs > threshold).astype(float)
    change = np.abs(np.diff(pos, prepend=pos[0]))
    s = pos * r - change * 0.001
    cum = np.cumprod(1 + s)
    top = np.maximum.accumulate(cum)
    for column, want in [("strategy_return", s), ("cum_strategy", cum), ("cum_buyhold", np.cumprod(1 + r)), ("drawdown", (cum - top) / top)]:
        np.testing.assert_allclose(got[column], want, rtol=1e-9, atol=1e-12)
    assert (got["drawdown"] <= 0).all()
    m = strategy.risk_metrics(equity).first()
    held = s[pos == 1]
    assert m["n_trades"] == int(change.sum()) and m["days_invested"] == int(pos.sum())
    assert m["sharpe_ratio"] == round(s.mean() / s.std() * np.sqrt(252), 3)
    assert m["max_drawdown"] == round(((cum - top) / top).min(), 4)
    assert m["win_rate"] == round((held > 0).mean(), 4)
    assert m["profit_factor"] == round(held[held > 0].sum() / -held[held < 0].sum(), 3)
    assert m["annual_return"] == round(cum[-1] ** (252 / len(s)) - 1, 4)


def test_best_threshold_prefers_the_first_on_ties(spark):
    rows = [("A", 0.6, 1.0), ("A", 0.5, 1.0), ("A", 0.55, 0.5)]
    got = strategy.best_threshold(spark.createDataFrame(rows, "ticker string, threshold double, sharpe_ratio double")).first()
    assert got["threshold"] == 0.5


def test_event_study_summary_verdicts(spark):
    rows = [("A", 1.0, True), ("A", 2.0, True), ("B", -1.0, False), ("B", 0.5, True), ("B", 0.5, True), ("B", -9.0, True), ("B", -1.0, False),
            ("C", -1.0, False)]
    got = {r["ticker"]: r for r in stats.event_study_summary(
        spark.createDataFrame(rows, "ticker string, return_pct double, recovered boolean")).collect()}
    assert (got["A"]["verdict"], got["B"]["verdict"], got["C"]["verdict"]) == ("EFFECTIVE", "MILD", "WEAK")
    assert got["A"]["median_return"] == 1.5
