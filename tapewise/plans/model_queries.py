"""Model queries: fits run when the query is built, the result is a table.

Probabilities depend on a solver, so SQL cannot give them. A query of the plain name returns what is determined
(keys, sizes, rates, sums that must be zero) and has reference SQL; ``*_scores`` returns all columns. Property
tests cover the probabilities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.functions.fixed_values import HORIZONS
from tapewise.operators import attribution, explain, features as feat, metrics, models, stats, ticker_fits
from tapewise.operators.signals import company_name
from tapewise.plans.oracle import sql
from tapewise.plans.registry import query, rounded
from tapewise.plans.tables import Tables
from tapewise.schemas import FEATURES, FEATURES_WITH_SENTIMENT
from tapewise.sources import staging

_fitted: dict[tuple[str, str, str], models.Classifier] = {}


#: The dataset with the rank of each date among all dates, and its last fifth of days.
_POOLED = {
    "pooled": (["dataset"], """
        SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS day, (SELECT count(DISTINCT date) FROM dataset) AS days FROM dataset"""),
    "walked": (["pooled"], """
        SELECT *, (SELECT greatest(st, st + 21 * CAST(ceil((150 - st) / 21e0) AS BIGINT))
                   FROM (SELECT CAST(floor(max(days) * 0.5e0) AS BIGINT) AS st FROM pooled)) AS first FROM pooled"""),
    "blocks": (["walked"], "SELECT *, CAST(floor((day - first) / 21e0) AS INTEGER) AS win FROM walked WHERE day >= first"),
    "sizes": (["blocks"], """
        SELECT w.win, count(*) AS train_size FROM (SELECT DISTINCT win, first FROM blocks) w JOIN walked p ON p.day < w.first + 21 * w.win
        GROUP BY w.win"""),
    "tested": (["pooled"], "SELECT * FROM pooled WHERE day >= floor(days * 0.8e0)"),
}


def _sql(select: str, *names: str) -> str:
    return sql(select, *names, extra=_POOLED)


def _probable(column: str = "prob"):
    return F.col(column).between(0.0, 1.0).alias("probable")


def _split(t: Tables):
    """Training rows (read many times by a fit, so written once) and test rows, cut by date."""
    placed = t.placed("dataset")
    return placed.filter("day < cut"), placed.filter("day >= cut")


def _fit(kind: str, train: DataFrame, columns: list[str] = FEATURES) -> models.Classifier:
    with models.cached(train):
        return models.fit(kind, train, columns)


def _shared(t: Tables, kind: str) -> models.Classifier:
    """The model of the base features, fitted once per application and data folder."""
    key = (t.spark.sparkContext.applicationId, t.dir, kind)
    if key not in _fitted:
        _fitted[key] = _fit(kind, _split(t)[0])
    return _fitted[key]


def _scorecard(kind: str, scored):
    return models.evaluate(scored).withColumn("model", F.lit(kind))


@query("train_logistic_scores")
def _train_logistic(t: Tables):
    return _scorecard("logistic", _shared(t, "logistic").score(_split(t)[1]))


@query("train_logistic", _sql("SELECT 'logistic' AS model, count(*) AS n, round(avg(label), 6) AS up_rate, true AS better_than_chance FROM tested", "tested"))
def _(t: Tables):
    return rounded(_train_logistic(t), 6, "up_rate").select("model", "n", "up_rate", (F.col("roc_auc") > 0.5).alias("better_than_chance"))



@query("train_gbt_scores")
def _train_gbt(t: Tables):
    return _scorecard("gbt", _shared(t, "gbt").score(_split(t)[1]))


@query("train_gbt", _sql("SELECT 'gbt' AS model, count(*) AS n, round(avg(label), 6) AS up_rate, true AS better_than_chance FROM tested", "tested"))
def _(t: Tables):
    return rounded(_train_gbt(t), 6, "up_rate").select("model", "n", "up_rate", (F.col("roc_auc") > 0.5).alias("better_than_chance"))



@query("cross_validate_scores")
def _cross_validate(t: Tables):
    train, _test = _split(t)
    return models.cross_validate(train, FEATURES, kind="gbt")


@query("cross_validate", _sql("""
    SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, true AS better_than_chance FROM (
        SELECT *, CAST(floor((day - first) / size) + 1 AS INTEGER) AS fold FROM (
            SELECT *, days80 // 4 AS size, days80 - 3 * (days80 // 4) AS first
            FROM (SELECT *, CAST(floor(days * 0.8e0) AS BIGINT) AS days80 FROM pooled) a WHERE day < days80) b WHERE day >= first) c
    GROUP BY fold""", "pooled"))
def _(t: Tables):
    return _cross_validate(t).select("fold", "n", (F.col("roc_auc") > 0.5).alias("better_than_chance"))



@query("walkforward_backtest_scores")
def _walkforward_backtest(t: Tables):
    return models.walkforward_backtest(t.dataset(), FEATURES)


#: Days between refits of the trees in the registered walk-forward; a refit every 21 days is four times the work.
TREE_STEP = 126


def _walked(step: int) -> str:
    """The keys, training sizes and labels of a walk-forward with refits every ``step`` days."""
    by_step = {name: (needs, body.replace("21", str(step))) for name, (needs, body) in _POOLED.items()}
    return sql("""
        SELECT ticker, date, win AS "window", train_size, label AS actual, true AS probable FROM blocks JOIN sizes USING (win)""", "blocks", "sizes", extra=by_step)


@query("walkforward_backtest", _walked(21))
def _(t: Tables):
    return _walkforward_backtest(t).select("ticker", "date", "window", "train_size", "actual", _probable())



def _walkforward_trees(t: Tables):
    """All windows' boosters share their passes; the predictions are written once per application."""
    return staging.staged(t.spark, t.dir, "walkforward_trees", lambda: models.walkforward_backtest(t.dataset(), FEATURES, kind="gbt", step=TREE_STEP))


@query("walkforward_trees", _walked(TREE_STEP))
def _(t: Tables):
    return _walkforward_trees(t).select("ticker", "date", "window", "train_size", "actual", _probable())


@query("walkforward_trees_windows")
def _(t: Tables):
    return metrics.window_results(_walkforward_trees(t))


@query("per_ticker_models_scores")
def _per_ticker_models(t: Tables):
    return ticker_fits.per_ticker_models(t.dataset(), FEATURES)


@query("per_ticker_models", sql("""
    SELECT ticker, date, CAST(floor(n_rows * 0.8e0) AS BIGINT) AS train_size, true AS converged, true AS probable
    FROM placed WHERE pos = n_rows - 1""", "placed"))
def _(t: Tables):
    return _per_ticker_models(t).select("ticker", "date", "train_size", "converged", _probable("prob_up"))



@query("score_latest_scores")
def _score_latest(t: Tables):
    latest = feat.derived_features(stats.latest_row(t.features()))
    return company_name(attribution.score_latest(_shared(t, "gbt"), latest), t.metadata())


@query("score_latest", _sql("""
    SELECT ticker, max(date) AS date, 1e0 AS total, (SELECT count(*) FROM pooled WHERE day < floor(days * 0.8e0)) AS training_samples
    FROM feat GROUP BY ticker""", "feat", "pooled"))
def _(t: Tables):
    return _score_latest(t).select("ticker", "date", F.round(F.col("prob_up") + F.col("prob_down"), 4).alias("total"), "training_samples")



@query("platt_scale_scores")
def _platt_scale(t: Tables):
    train, test = _split(t)
    model = _shared(t, "gbt")
    out = models.calibrated(model, models.platt_scale(model, train), test)
    return out.select("ticker", "date", "raw_prob", "prob", "label")


@query("platt_scale", _sql("SELECT ticker, date, label, true AS probable FROM tested", "tested"))
def _(t: Tables):
    return _platt_scale(t).select("ticker", "date", "label", _probable())



@query("coef_ranking")
def _(t: Tables):
    train, _test = _split(t)
    return models.coef_ranking(_shared(t, "logistic"), train)


@query("model_comparison_scores")
def _model_comparison(t: Tables):
    test = _split(t)[1]
    up = test.agg(F.avg("label").alias("accuracy")).select(F.lit("always up").alias("model"), "accuracy", F.lit(0.5).alias("roc_auc"))
    out = up
    for kind in ("logistic", "gbt"):
        row = _scorecard(kind, _shared(t, kind).score(test))
        out = out.unionByName(row.select("model", "accuracy", "roc_auc"))
    return out


@query("model_comparison", _sql("""
    SELECT 'always up' AS model, round(avg(label), 6) AS accuracy, true AS better_than_chance FROM tested
    UNION ALL SELECT m, NULL, true FROM (VALUES ('logistic'), ('gbt')) v(m)""", "tested"))
def _(t: Tables):
    up = F.col("model") == "always up"
    return _model_comparison(t).select("model", F.when(up, F.round("accuracy", 6)).alias("accuracy"), (up | (F.col("roc_auc") > 0.5)).alias("better_than_chance"))



def _sweep(t: Tables):
    return models.horizon_sweep(t.labelled(), HORIZONS, FEATURES)


@query("horizon_sweep_scores")
def _(t: Tables):
    return rounded(_sweep(t), 4, "accuracy", "roc_auc", "up_rate")


def _horizon(h: int) -> str:
    """Test rows of one horizon: the last fifth of the days that have its label."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
    return f"""
        SELECT {h} AS horizon, CASE WHEN (future - close) / close > 0 THEN 1 ELSE 0 END AS up, dense_rank() OVER (ORDER BY date) - 1 AS day
        FROM (SELECT *, CAST(lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) AS DOUBLE) AS future FROM derived) f{h}
        WHERE future IS NOT NULL AND {known}"""


@query("horizon_sweep", sql(f"""
    SELECT horizon, count(*) AS test_samples, round(avg(up), 6) AS up_rate
    FROM (SELECT *, max(day) OVER (PARTITION BY horizon) + 1 AS days FROM ({" UNION ALL ".join(f"({_horizon(h)})" for h in HORIZONS)}) a) b
    WHERE day >= floor(days * 0.8e0) GROUP BY horizon""", "derived"))
def _(t: Tables):
    return _sweep(t).select("horizon", "test_samples", F.round("up_rate", 6).alias("up_rate"))


@query("best_horizon")
def _(t: Tables):
    return models.best_horizon(rounded(_sweep(t), 4, "roc_auc"))


@query("sentiment_ablation")
def _(t: Tables):
    placed = t.placed("dataset_sentiment")
    train, test = placed.filter("day < cut"), placed.filter("day >= cut")

    def score(model: models.Classifier) -> tuple[float, float]:
        row = models.evaluate(model.score(test)).first()
        return row["accuracy"], row["roc_auc"]

    base, full = models.train_ablation(train, [FEATURES, FEATURES_WITH_SENTIMENT])
    rows = [(*score(base), *score(full))]
    both = t.spark.createDataFrame(rows, "accuracy_base double, auc_base double, accuracy_full double, auc_full double")
    return models.sentiment_verdict(both)


def _contributions(t: Tables, kind: str):
    out = attribution.attribute(_shared(t, kind), _split(t)[1])
    return out.select("ticker", "date", "prob", "margin", "base_value", "contributions")


def _gap(t: Tables, kind: str):
    """How far the base value and all parts are from the margin."""
    out = attribution.attribute(_shared(t, kind), _split(t)[1])
    total = F.aggregate("parts", F.col("base_value"), lambda a, x: a + x)
    return out.select("ticker", "date", F.round(F.abs(total - F.col("margin")), 6).alias("gap"))


@query("linear_attribution_scores")
def _linear_attribution(t: Tables):
    return _contributions(t, "logistic")


@query("linear_attribution", _sql("SELECT ticker, date, 0e0 AS gap FROM tested", "tested"))
def _(t: Tables):
    return _gap(t, "logistic")



@query("tree_attribution_scores")
def _tree_attribution(t: Tables):
    return _contributions(t, "gbt")


@query("feature_importance_trees")
def _(t: Tables):
    return explain.feature_importance(_contributions(t, "gbt"))


@query("tree_attribution", _sql("SELECT ticker, date, 0e0 AS gap FROM tested", "tested"))
def _(t: Tables):
    return _gap(t, "gbt")



