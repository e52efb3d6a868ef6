import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.operators import attribution, booster, explain, metrics, models, nested_fits, ticker_fits, trees
from tapewise.operators import indicators as ind
from tapewise.schemas import INDICATORS, NEWS_PAYLOAD, PRICES, RAW_BARS
from tapewise.sources import ingest, staging, store
from tapewise.streaming.incremental import Refresher, daily_refresh, sentiment_refresh
from tests.conftest import walk
from tests.test_panel import collected

XS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    parts = []
    for t in ("A", "B"):
        x = rng.normal(0, [1, 5, 0.1], (600, 3))
        y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [1.0, -0.2, 3.0])))).astype(int)
        days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(600)]
        parts.append(pd.DataFrame(x, columns=XS).assign(ticker=t, date=days, label=y))
    return spark.createDataFrame(pd.concat(parts)).cache()


def ridge_fit(x, y):
    """Ridge logistic weights on standardised features, intercept last and not penalised, by Newton steps."""
    a = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    ridge, w = np.diag(np.r_[np.ones(x.shape[1]), 0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a @ w)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
    return w


def test_logistic_solves_the_stated_objective(labelled):
    train, test = models.split(labelled)
    model = models.train_logistic(train, XS)
    pdf = train.toPandas()
    want = ridge_fit(pdf[XS].to_numpy(), pdf["label"].to_numpy(float))
    n = len(pdf)
    np.testing.assert_allclose(model.fitted.coefficients.toArray() * np.sqrt((n - 1) / n), want[:-1], rtol=2e-3, atol=2e-4)
    scored = models.evaluate(model.score(test)).first()
    assert scored["n"] == 240 and scored["roc_auc"] > 0.75
    ranking = models.coef_ranking(model, train).collect()
    assert [abs(r["coefficient"]) for r in ranking] == sorted((abs(r["coefficient"]) for r in ranking), reverse=True)


def test_nested_fits_equal_single_fits(labelled):
    rows = models.date_positions(labelled).cache()
    got = nested_fits.fit_nested(rows, XS, [150, 151, 400])
    pdf = rows.toPandas()
    for m, cut in enumerate([150, 151, 400]):
        part = pdf[pdf["day"] < cut]
        np.testing.assert_allclose(got.weights[m], ridge_fit(part[XS].to_numpy(), part["label"].to_numpy(float)), rtol=1e-6, atol=1e-8)
        assert got.train_size[m] == len(part)


def test_walkforward_trains_on_the_past_only(labelled):
    got = models.walkforward_backtest(labelled, XS).toPandas()
    assert len(got) == 600 and got["window"].nunique() == 15 and set(got["train_size"]) == {2 * d for d in range(300, 600, 21)}
    # what happens after the first block must not change its predictions
    changed = labelled.withColumn("label", F.when(F.col("date") >= dt.date(2020, 1, 1) + dt.timedelta(days=321), 1 - F.col("label")).otherwise(F.col("label")))
    again = models.walkforward_backtest(changed, XS).toPandas()
    first = [d[d["window"] == 0].sort_values(["ticker", "date"])["prob"].to_numpy() for d in (got, again)]
    np.testing.assert_allclose(*first)
    with pytest.raises(ValueError):
        models.walkforward_backtest(labelled, XS, min_train=1000)
    summary = metrics.walkforward_summary(metrics.window_results(labelled.sparkSession.createDataFrame(got))).toPandas()
    assert set(summary["windows"]) == {15}


def test_walkforward_with_spark_trees(labelled):
    got = models.walkforward_backtest(labelled, XS, kind="spark_gbt", step=150, trees=3, depth=2).toPandas()
    assert len(got) == 600 and got["prob"].between(0, 1).all() and got["window"].nunique() == 2


@pytest.mark.parametrize("kind,options", [("logistic", {}), ("gbt", {"trees": 8, "depth": 3}), ("spark_gbt", {"trees": 8, "depth": 3})])
def test_attributions_sum_to_the_margin(labelled, kind, options):
    train, test = models.split(labelled)
    out = attribution.attribute(models.fit(kind, train, XS, **options), test).toPandas()
    total = out["base_value"] + out["parts"].map(sum)
    np.testing.assert_allclose(total, out["margin"], atol=1e-9)
    np.testing.assert_allclose(1 / (1 + np.exp(-out["margin"])), out["prob"], atol=1e-9)
    assert explain.feature_importance(attribution.attribute(models.fit(kind, train, XS, **options), test)).count() == 3


def plain_booster(x, y, key, cuts, s):
    """The margins of training rows and the trees (as nested tuples), grown node by node on sums of floats."""
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    soft = lambda g: np.sign(g) * max(abs(g) - s.alpha, 0)
    score = lambda g, h: soft(g) ** 2 / (h + s.lam)
    margin, grown = np.zeros(len(x)), []
    for number in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        columns = booster.sampled_columns(s, number, x.shape[1])
        sample = booster.mixed(key, s.seed + 1000 * number) < s.rows

        def grow(rows, level):
            a, b = g[rows].sum(), h[rows].sum()
            best = None
            for f in columns if level else ():
                for cut in range(len(cuts[f])):
                    side = bins[rows, f] <= cut
                    left, right = rows[side], rows[~side]
                    if h[left].sum() >= s.weight and h[right].sum() >= s.weight:
                        gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(a, b)
                        if gain > (best[0] if best else 0) + 1e-9:
                            best = gain, f, cut, left, right
            if best:
                gain, f, cut, left, right = best
                left, right = grow(left, level - 1), grow(right, level - 1)
                if gain >= s.gamma or len(left) > 1 or len(right) > 1:
                    return f, cut, left, right
            return (-s.rate * soft(a) / (b + s.lam),)

        tree = grow(np.flatnonzero(sample), s.depth)

        def value(row, node):
            return node[0] if len(node) == 1 else value(row, node[2] if bins[row, node[0]] <= node[1] else node[3])

        margin = margin + np.array([value(r, tree) for r in range(len(x))])
        grown.append(tree)
    return margin, grown


def test_booster_equals_a_plain_one(spark, labelled):
    rows = models.date_positions(labelled).withColumn("_key", F.xxhash64("ticker", "date")).withColumn("x2", F.when(F.col("day") % 7 != 0, F.col("x2")))
    pdf = rows.toPandas()
    s = booster.Settings(trees=7, depth=3, rate=0.3, columns=0.7, bins=16)
    edges = [200.0, 450.0]
    got = booster.fit_boosted(rows.repartition(5), XS, edges, settings=s)
    cuts = booster.cut_points(rows.filter("day < 200"), XS, s.bins)
    for model, edge in zip(got, edges):
        part = pdf[pdf["day"] < edge]
        x = part[XS].to_numpy(float)
        want, _ = plain_booster(x, part["label"].to_numpy(float), part["_key"].to_numpy(np.int64).view(np.uint64), cuts, s)
        np.testing.assert_allclose(model.margins(x), want, atol=1e-6)
    # neither partitions nor the other window change a model
    single = booster.fit_boosted(rows.filter("day < 200").coalesce(1), XS, [200.0], settings=s)[0]
    for a, b in zip(single.trees, got[0].trees):
        assert (a.feature == b.feature).all() and (a.value == b.value).all() and (a.threshold == b.threshold).all()


def test_feature_sets_share_passes(labelled):
    train, _ = models.split(labelled)
    both = models.train_ablation(train, [XS[:2], XS], trees=3, depth=2)
    alone = models.train_gbt(train, XS[:2], trees=3, depth=2)
    for a, b in zip(both[0].model.trees, alone.model.trees):
        assert (a.feature == b.feature).all() and (a.value == b.value).all() and set(a.feature) <= {-1, 0, 1}
    assert any(2 in t.feature for t in both[1].model.trees)


def test_small_sums_need_no_exchange_and_equal_exchanged_ones(labelled, monkeypatch):
    exchanged, plain, fits = [], type(labelled).repartition, []
    monkeypatch.setattr(type(labelled), "repartition", lambda self, *by: exchanged.append(by) or plain(self, *by))
    for limit in (booster._Passes.DIRECT, -1):
        monkeypatch.setattr(booster._Passes, "DIRECT", limit)
        fits.append((booster.fit_boosted(labelled, XS, settings=booster.Settings(trees=3, depth=3))[0], len(exchanged)))
    assert fits[0][1] == 0 < fits[1][1]
    for one, other in zip(fits[0][0].trees, fits[1][0].trees):
        for x, y in zip(vars(one).values(), vars(other).values()):
            np.testing.assert_array_equal(x, y)


def test_booster_predicts_and_explains(labelled, monkeypatch):
    monkeypatch.setattr(booster, "KEPT_TREES", 4)  # margins are written anew in between
    train, test = models.split(labelled)
    model = models.fit("gbt", train, XS, trees=12, rate=0.2)
    assert models.evaluate(model.score(test)).first()["roc_auc"] > 0.75 and model.train_size == 960
    out = attribution.attribute(model, test).toPandas()
    np.testing.assert_allclose(out["base_value"] + out["parts"].map(sum), out["margin"], atol=1e-9)
    latest = attribution.score_latest(model, test.filter("day = days - 1")).toPandas()
    assert len(latest) == 2 and all(len(f) == 3 for f in latest["top_features"])
    calibrated = models.calibrated(model, models.platt_scale(model, train), test)
    assert calibrated.filter("prob > 0 AND prob < 1").count() == 240


def test_walkforward_and_folds_with_boosters_equal_single_fits(labelled):
    options = {"trees": 4, "depth": 2, "rate": 0.5}
    got = models.walkforward_backtest(labelled, XS, kind="gbt", step=150, **options).toPandas().sort_values(["ticker", "date"])
    assert len(got) == 600 and got["window"].nunique() == 2 and set(got["train_size"]) == {600, 900}
    panel = models.date_positions(labelled)
    one = booster.fit_boosted(panel, XS, [300.0], settings=booster.Settings(**options))[0]
    first = panel.filter("day >= 300 AND day < 450").toPandas().sort_values(["ticker", "date"])
    np.testing.assert_allclose(got[got["window"] == 0]["prob"], 1 / (1 + np.exp(-one.margins(first[XS].to_numpy(float)))))
    folds = models.cross_validate(labelled, XS, kind="gbt", **options).toPandas()
    assert list(folds.sort_values("fold")["n"]) == [300, 300, 300] and (folds["roc_auc"] > 0.5).all()


def enumerated(tree, x):
    """Shapley values by all subsets of all features, each valued by walking the tree."""
    d = len(x)

    def value(known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return value(known, left if x[f] <= tree.threshold[node] else right)
        return (tree.cover[left] * value(known, left) + tree.cover[right] * value(known, right)) / tree.cover[node]

    out = np.zeros(d)
    for f in range(d):
        rest = [g for g in range(d) if g != f]
        for size in range(d):
            for some in combinations(rest, size):
                weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                out[f] += weight * (value({*some, f}) - value(set(some)))
    return out


def random_tree(rng, depth, features):
    rows = []

    def grow(level, cover):
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, rng.normal(), cover])
        if level and cover > 3 and rng.random() < 0.9:
            part = int(rng.integers(1, cover))
            rows[at][:2] = int(rng.integers(features)), float(np.round(rng.normal(), 1))
            rows[at][2], rows[at][3] = grow(level - 1, part), grow(level - 1, cover - part)
        return at

    grow(depth, 100)
    return trees.Tree(*(np.array(c) for c in zip(*rows)))


def test_shapley_values_equal_all_subsets():
    rng = np.random.default_rng(6)
    for _ in range(25):
        grown = [random_tree(rng, 4, 4) for _ in range(3)]
        x = np.round(rng.normal(size=(7, 4)), 1)
        x[0, 1] = np.nan
        shapley = trees.Shapley(grown, [1.0, 0.5, 2.0], 4)
        got = shapley.values(x)
        want = np.array([sum(s * enumerated(t, row) for t, s in zip(grown, (1.0, 0.5, 2.0))) for row in x])
        np.testing.assert_allclose(got, want, atol=1e-12)
        total = sum(s * t.predict(x) for t, s in zip(grown, (1.0, 0.5, 2.0)))
        np.testing.assert_allclose(shapley.base + got.sum(axis=1), total, atol=1e-12)


def test_shapley_values_of_a_fitted_model(labelled):
    """The model's own trees: their covers add up, and the values are those of all subsets."""
    train, test = models.split(labelled)
    model = models.fit("spark_gbt", train, XS, trees=4, depth=3)
    grown = [trees.of_spark(t) for t in model.fitted._java_obj.trees()]
    for t in grown:
        inner = np.flatnonzero(t.feature >= 0)
        np.testing.assert_allclose(t.cover[inner], t.cover[t.left[inner]] + t.cover[t.right[inner]])
    out = attribution.tree_attribution(model, test.limit(20)).toPandas()
    scales = [2.0 * w for w in model.fitted.treeWeights]
    for parts, row in zip(out["parts"], out[XS].to_numpy()):
        np.testing.assert_allclose(parts, sum(s * enumerated(t, row) for t, s in zip(grown, scales)), atol=1e-10)


def test_platt_and_latest(labelled):
    train, test = models.split(labelled)
    model = models.train_gbt(train, XS, trees=5, depth=2)
    out = models.calibrated(model, models.platt_scale(model, train), test).toPandas()
    ranks = out[["raw_prob", "prob"]].rank()
    assert np.corrcoef(ranks["raw_prob"], ranks["prob"])[0, 1] > 0.999  # a monotone map
    latest = attribution.score_latest(model, test.filter("day = days - 1")).toPandas()
    assert len(latest) == 2 and all(len(f) == 3 for f in latest["top_features"]) and (latest["training_samples"] == 960).all()


def test_cross_validation(labelled):
    got = models.cross_validate(labelled, XS, kind="logistic").toPandas()
    assert list(got.sort_values("fold")["n"]) == [300, 300, 300]
    assert np.isclose(got["auc_std"].iloc[0], got["roc_auc"].std(ddof=0))


def test_per_ticker_models_of_any_size(spark, labelled, monkeypatch):
    """Tickers of 600, 12, 1 and 0 training rows, one with equal labels; blocks of 7 rows give what one block gives."""
    pdf = labelled.toPandas()
    few = pdf[pdf["ticker"] == "A"].head(15).assign(ticker="FEW", label=[0, 1, 1] * 5)
    up = pdf[pdf["ticker"] == "A"].head(40).assign(ticker="UP", label=1)
    one = pdf.head(1).assign(ticker="ONE")
    two = pdf.head(2).assign(ticker="TWO", label=0)
    every = pd.concat([pdf, few, up, one, two])
    rows = spark.createDataFrame(every).repartition(4)
    whole = ticker_fits.per_ticker_models(rows, XS).toPandas().set_index("ticker").sort_index()
    monkeypatch.setattr(ticker_fits, "BLOCK_ROWS", 7)
    cut = ticker_fits.per_ticker_models(rows, XS).toPandas().set_index("ticker").sort_index()
    np.testing.assert_allclose(whole["prob_up"], cut["prob_up"], atol=1e-10)
    assert whole["train_size"].to_dict() == {"A": 480, "B": 480, "FEW": 12, "UP": 32, "ONE": 0, "TWO": 1} and whole["converged"].all()
    assert whole["prob_up"]["UP"] == 1.0 and np.isnan(whole["prob_up"]["ONE"]) and whole["prob_up"]["TWO"] == 0.0
    for name in ("A", "B", "FEW"):
        g = every[every["ticker"] == name].sort_values("date")
        n = whole["train_size"][name]
        x = g[XS].to_numpy()
        w = ridge_fit(x[:n], g["label"].to_numpy(float)[:n])
        z = ((x[-1] - x[:n].mean(0)) / x[:n].std(0)) @ w[:-1] + w[-1]
        assert abs(whole["prob_up"][name] - 1 / (1 + np.exp(-z))) < 1e-8


def test_blocks_of_one_ticker_meet_its_weights_in_many_slots(spark, labelled, monkeypatch):
    """A join on ticker alone would bring all blocks of a hot ticker into one task."""
    monkeypatch.setattr(ticker_fits, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ticker_fits, "SLOT_BLOCKS", 4)
    joins, whole = [], ticker_fits._sums
    monkeypatch.setattr(ticker_fits, "_sums", lambda joined, width: joins.append(joined) or whole(joined, width))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ticker_fits.per_ticker_models(labelled, XS, steps=3).count()
        plan = joins[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [ticker#" in plan and "slot#" in plan.split("SortMergeJoin [")[1].split("]")[0]
    assert joins[0].groupBy("ticker").count().filter("count >= 60").count() == 2  # 480 rows in 60 blocks, 15 slots


def test_all_horizons_in_one_fit_equal_single_fits(labelled):
    """Labels that end earlier for longer horizons; each model is that of its own rows and days."""
    rows = labelled.withColumns({"label_1": F.when(F.col("date") < dt.date(2021, 8, 20), F.col("label")),
                                 "label_5": F.when(F.col("date") < dt.date(2021, 6, 1), 1 - F.col("label"))})
    got = {r["horizon"]: r for r in models.horizon_sweep(rows, [1, 5], XS).collect()}
    for h, name in ((1, "label_1"), (5, "label_5")):
        known = models.date_positions(rows.filter(F.col(name).isNotNull()).withColumn("label", F.col(name))).toPandas()
        cut = int(known["days"].iloc[0] * 0.8)
        train, test = known[known["day"] < cut], known[known["day"] >= cut]
        x = train[XS].to_numpy()
        w = ridge_fit(x, train["label"].to_numpy(float))
        z = ((test[XS].to_numpy() - x.mean(0)) / x.std(0)) @ w[:-1] + w[-1]
        assert got[h]["test_samples"] == len(test) and abs(got[h]["up_rate"] - test["label"].mean()) < 1e-12
        assert abs(got[h]["accuracy"] - ((z > 0) == test["label"]).mean()) < 1e-12


def test_nested_fits_with_a_large_mean(labelled):
    rows = models.date_positions(labelled).cache()
    far = rows.withColumn("x1", F.col("x1") * 1e-3 + 1e6)
    a, b = (nested_fits.fit_nested(x, XS, [300]) for x in (rows, far))
    np.testing.assert_allclose(a.weights, b.weights, rtol=1e-5, atol=1e-6)


# ---- storage and refresh -------------------------------------------------------------------------------


def bars_of(spark, *frames):
    return spark.createDataFrame(pd.concat(frames)).select(*[F.col(f.name).cast(f.dataType) for f in PRICES])


def test_store_upsert_twice_is_once(spark, tmp_path):
    table = store.PanelStore(spark, str(tmp_path / "prices"), PRICES)
    base = bars_of(spark, walk("A", 900, 1), walk("B", 900, 2))
    assert table.read().count() == 0
    table.upsert(base)
    batch = bars_of(spark, walk("A", 900, 1)).filter("date >= '1992-12-01'").withColumn("close", F.lit(1.0))
    table.upsert(batch)
    once = collected(table.read())
    table.upsert(batch)
    pd.testing.assert_frame_equal(once, collected(table.read()))
    assert len(once) == 1800  # other months and tickers are untouched
    assert (once[once["close"] == 1.0]["ticker"] == "A").all() and (once["close"] == 1.0).sum() == batch.count()
    start = collected(table.read(start="1993-01-01"))
    assert len(start) == (pd.to_datetime(once["date"]) >= "1993-01-01").sum()
    plan = table.read(start="1993-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_stored_rows_are_rounded_and_hold_no_nan(spark):
    row = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.005, float("nan"), 1.0, 2.345678, 10)],
                                "ticker string, date date, open double, high double, low double, close double, volume long")
    got = store.price_rows(row).first()
    assert got["close"] == 2.35 and got["high"] is None


def test_csv_round_trip(spark, tmp_path):
    base = bars_of(spark, walk("X.NS", 50, 1), walk("Y", 20, 2))
    ingest.write_bars(base, str(tmp_path / "csv"), "1y")
    back = ingest.ingest_bars(ingest.reload_csv(spark, str(tmp_path / "csv")).withColumnRenamed("file_ticker", "ticker"))
    want = collected(base)
    want["ticker"] = want["ticker"].str.replace(".", "_")
    pd.testing.assert_frame_equal(collected(back), want)
    with pytest.raises(ValueError):
        ingest.require_rows(base.filter("close < 0"))


def test_one_bad_file_does_not_stop_the_load(spark, tmp_path):
    header, line = "Date,Open,High,Low,Close,Volume", "2020-01-0%d 00:00:00,1.0,2.0,0.5,1.5,10"
    folder = tmp_path / "bars"
    folder.mkdir()
    sound = "\n".join([header] + [line % d for d in (1, 2, 3)]) + "\n"
    texts = {"GOOD_2y": sound, "X_NS_2y": sound, "EMPTY_2y": "", "HEAD_2y": header + "\n", "CUT_2y": sound[:-20], "OTHER_2y": "a,b\n1,2\n", "NOBODY_2y": sound,
             "WORDS_2y": header + "\nyesterday,one,two,three,four,five\n"}
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    asked = spark.createDataFrame([(t,) for t in ("GOOD", "X.NS", "EMPTY", "HEAD", "CUT", "OTHER", "WORDS", "GONE", "GOOD")], "ticker string")
    raw, report = ingest.load_many(spark, asked, str(folder))
    got = {r["ticker"]: tuple(r)[1:] for r in report.collect()}
    assert got == {"GOOD": (True, 3, 0, None), "X.NS": (True, 3, 0, None), "EMPTY": (False, 0, 0, "empty"), "HEAD": (False, 0, 0, "no rows"),
                   "CUT": (True, 2, 1, "broken lines"), "OTHER": (False, 0, 2, "wrong header"), "WORDS": (False, 0, 1, "no rows"), "GONE": (False, 0, 0, "missing")}
    bars = ingest.ingest_bars(raw).groupBy("ticker").count().collect()
    assert {r["ticker"]: r["count"] for r in bars} == {"GOOD": 3, "X.NS": 3, "CUT": 2}


def test_files_as_written_are_loaded(spark, tmp_path):
    base = bars_of(spark, walk("X.NS", 50, 1), walk("Y#1", 20, 2))
    ingest.write_bars(base, str(tmp_path / "csv"))
    raw, report = ingest.load_many(spark, spark.createDataFrame([("X.NS",), ("Y#1",), ("Z",)], "ticker string"), str(tmp_path / "csv"))
    assert {r["ticker"]: (r["loaded"], r["rows"], r["reason"]) for r in report.collect()} == {"X.NS": (True, 50, None), "Y#1": (True, 20, None), "Z": (False, 0, "missing")}
    pd.testing.assert_frame_equal(collected(ingest.ingest_bars(raw)), collected(base))


def test_raw_bars_lose_rows_without_close(spark):
    raw = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, None, 5.0), (dt.datetime(2020, 1, 2), 1.0, 1.0, 1.0, 2.0, 5.0)], RAW_BARS)
    assert ingest.ingest_bars(raw.withColumn("ticker", F.lit("A"))).count() == 1


def test_news_payloads(spark, tmp_path):
    lines = ['{"ticker": "A", "status": "ok", "articles": [{"source": {"name": null}, "title": "t", "description": null, "publishedAt": "2024-01-02T03:04:05Z"}]}',
             '{"ticker": "B", "status": "error", "articles": []}', '{"ticker": "C", "status": "ok", "articles": []}']
    (tmp_path / "n.json").write_text("\n".join(lines))
    got = ingest.ingest_news(ingest.read_news(spark, str(tmp_path / "n.json"))).collect()
    assert [tuple(r) for r in got] == [("A", dt.date(2024, 1, 2), "t", "", "")]
    assert NEWS_PAYLOAD.names == ["ticker", "status", "articles"]


def test_news_window_keeps_what_is_asked_for(spark):
    rows = spark.range(1000).select(F.concat(F.lit("T"), F.col("id") % 2).alias("ticker"), F.date_sub(F.lit(dt.date(2024, 1, 31)), (F.col("id") % 40).cast("int")).alias("date"), "id")
    got = ingest.news_window(rows, F.lit(dt.date(2024, 1, 31)), days_back=7, max_articles=500, order=[F.col("id")])
    assert got.count() == 200 and ingest.news_window(rows, F.lit(dt.date(2024, 1, 31)), days_back=7, max_articles=50, order=[F.col("id")]).count() == 100
    assert got.agg(F.min("date")).first()[0] >= dt.date(2024, 1, 24)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # every task keeps its own newest rows before the exchange


def test_a_batch_reads_from_the_last_state_on(spark, tmp_path):
    """Months before the state and tickers that the batch does not have are not read, and the result is that of all bars."""
    work = Refresher(spark, str(tmp_path / "store"))
    whole = bars_of(spark, walk("A", 3000, 1), walk("B", 2900, 2), walk("LATE", 40, 3))
    last = walk("A", 3000, 1)["date"].iloc[-30]
    work.apply(whole.filter(F.col("date") < last), "old")
    states = collected(work.states.read().withColumnRenamed("_unit", "date"))
    assert len(states) == whole.filter(F.col("date") < last).select("ticker", F.year("date"), F.quarter("date")).distinct().count()
    begin = work.beginnings(spark.createDataFrame([("A", last), ("NEW", last)], "ticker string, since date"))
    by = {r["ticker"]: r for r in begin.collect()}
    assert by["NEW"]["_start"] is None and by["A"]["_start"] > 2500 and by["A"]["_seen_gain"] == by["A"]["_start"] - 1
    rows = work.history(begin)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "month#" in plan.split("PartitionFilters")[1].split("]")[0] and "In(ticker, [A,NEW])" in plan
    got = collected(rows)
    assert set(got["ticker"]) == {"A"} and 50 <= len(got) < 50 + 2 * 92
    work.apply(whole.filter(F.col("date") >= last), "new")
    want, have = collected(store.indicator_rows(ind.indicators_all(whole))), collected(work.indicators.read())
    assert len(have) == len(want)
    for c in INDICATORS.names[2:]:
        np.testing.assert_allclose(have[c], want[c], rtol=1e-9, atol=2e-6)


def test_states_across_gaps_and_corrections(spark, tmp_path):
    """Unknown prices around the state, late corrections and a ticker that begins later: as if all bars came at once."""
    frame = pd.concat([walk("A", 1500, 1), walk("B", 900, 2)])
    at = frame.groupby("ticker").cumcount()
    frame.loc[at.between(600, 1100) & (at % 9 != 0), ["close", "high"]] = np.nan
    whole = bars_of(spark, frame).replace(float("nan"), None)
    work, days = Refresher(spark, str(tmp_path / "store")), sorted(frame["date"])
    cuts = [days[0], days[800], days[1500], days[2000], dt.date(2100, 1, 1)]
    for low, high in zip(cuts, cuts[1:]):
        work.apply(whole.filter((F.col("date") >= low) & (F.col("date") < high)).withColumn("close", F.col("close") * (2 if low == cuts[1] else 1)))
    work.apply(whole.filter((F.col("date") >= cuts[1]) & (F.col("date") < cuts[2])))
    want, have = collected(store.indicator_rows(ind.indicators_all(whole))), collected(work.indicators.read())
    assert len(have) == len(want) > 0
    for c in INDICATORS.names[2:]:
        np.testing.assert_allclose(have[c], want[c], rtol=1e-8, atol=2e-6)


def test_a_repeated_batch_is_logged_once(spark, tmp_path):
    log = store.Ledger(spark, str(tmp_path / "loads"))
    assert log.read().count() == 0
    first, second = bars_of(spark, walk("A", 20, 1)), bars_of(spark, walk("A", 30, 1), walk("B", 10, 2))
    for name, rows in (("1", first), ("2", second), ("1", first)):
        log.record(name, rows)
    got = {(r["batch"], r["ticker"]): r["rows"] for r in log.read().collect()}
    assert got == {("1", "A"): 20, ("2", "A"): 30, ("2", "B"): 10}
    last = {r["ticker"]: r["last_fetched"] for r in store.fetch_log(log.read()).collect()}
    assert last["A"] >= last["B"]


def test_incremental_equals_batch(spark, tmp_path):
    whole = bars_of(spark, walk("A", 2600, 1), walk("B", 1200, 2), walk("C", 30, 3))
    feed = str(tmp_path / "feed")
    old = F.col("date") < dt.date(1998, 1, 1)
    whole.filter(old).coalesce(1).write.parquet(feed)
    work = Refresher(spark, str(tmp_path / "store"))
    work.run(feed, str(tmp_path / "checkpoint"))
    whole.filter(~old).coalesce(1).write.mode("append").parquet(feed)
    work.run(feed, str(tmp_path / "checkpoint"))
    work.run(feed, str(tmp_path / "checkpoint"))  # nothing new
    want = collected(store.indicator_rows(ind.indicators_all(whole)))
    got = collected(work.indicators.read())
    assert len(got) == len(want)
    for c in INDICATORS.names[2:]:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=2e-6)
    assert work.loads.read().select("batch").distinct().count() == 2
    work.refresh_tickers(spark.createDataFrame([("A",)], "ticker string"))
    pd.testing.assert_frame_equal(collected(work.indicators.read()), got, rtol=1e-9, atol=2e-6)


def test_refresh_reports_missing_tickers(spark, tmp_path):
    bars = bars_of(spark, walk("A", 800, 1), walk("C", 30, 3))
    asked = spark.createDataFrame([("A",), ("C",), ("NONE",)], "ticker string")
    got = {r["ticker"]: r for r in daily_refresh(spark, bars, asked, 2, str(tmp_path / "d")).collect()}
    assert got["A"]["success"] and got["A"]["indicator_rows"] > 0 and got["C"]["indicator_rows"] == 0 and not got["NONE"]["success"]
    news = spark.createDataFrame([("A", dt.date(1990, 2, 1), 0.5)], "ticker string, date date, sentiment_score double")
    seen = {r["ticker"]: r["success"] for r in sentiment_refresh(spark, news, bars, asked, str(tmp_path / "s")).collect()}
    assert seen == {"A": True, "C": False, "NONE": False}


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = staging.new_path(spark, "t")
    assert path.startswith(named if named else "/tmp/run-") and spark.sparkContext.applicationId in path


def test_embargo_shrinks_the_training_set(labelled):
    plain, gap = (models.walkforward_backtest(labelled, XS, embargo=n).filter("window = 0").first()["train_size"] for n in (0, 10))
    assert plain - gap == 20  # ten days of two tickers


def test_upsert_keeps_the_last_row_of_a_repeated_key(spark, tmp_path):
    kinds = "ticker string, date date, open double, high double, low double, close double, volume long, n int"
    day = dt.date(2020, 1, 1)
    base = spark.createDataFrame([("A", day, 1.0, 1.0, 1.0, 1.0, 1, 0), ("B", day, 1.0, 1.0, 1.0, 1.0, 1, 0)], kinds).drop("n")
    batch = spark.createDataFrame([("A", day, 3.0, 3.0, 3.0, 3.0, 3, 2), ("A", day, 9.0, 9.0, 9.0, None, 9, 1), ("C", day, 2.0, 2.0, 2.0, 2.0, 2, 1)] * 2, kinds)
    got = {r["ticker"]: r["close"] for r in store.upsert(base, batch, order=["n"]).collect()}
    assert got == {"A": 3.0, "B": 1.0, "C": 2.0} and store.upsert(base, batch, order=["n"]).count() == 3
    table = store.PanelStore(spark, str(tmp_path / "t"), PRICES)
    table.upsert(base)
    table.upsert(batch.drop("n"))
    assert table.read().count() == 3
