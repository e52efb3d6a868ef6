"""Direction classifiers on Spark ML, their evaluation, calibration and backtest."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.operators import metrics
from tapewise.operators.booster import Boosted, Settings, fit_boosted
from tapewise.operators.features import fold_of, train_rows
from tapewise.operators.nested_fits import fit_labels, fit_nested
from tapewise.operators.panel import numbered

KEY = ["ticker", "date"]
ALL = "all"  # single group of a pooled evaluation
TREE_ROWS = 10_000


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table in memory and on disk while several passes run over it."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class Classifier:
    """A fitted pipeline with the names of its features and the size of its training set."""

    kind: str
    features: list[str]
    model: PipelineModel
    train_size: int

    @property
    def fitted(self):
        return self.model.stages[-1]

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with prob (of a rise), margin (log-odds; twice the raw sum for trees) and pred."""
        out = self.model.transform(rows)
        raw = vector_to_array("_raw")
        # The trees' probability is 1/(1+exp(-2F)), so the log-odds are 2F.
        margin = raw[1] * 2 if self.kind == "spark_gbt" else raw[1]
        keep = [c for c in rows.columns]
        scored = out.select(*keep, vector_to_array("_prob")[1].alias("prob"), margin.alias("margin"))
        return scored.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


@dataclass
class BoostedClassifier(Classifier):
    """Trees of :mod:`booster`; ``model`` holds them. The margin is their sum."""

    model: Boosted

    def score(self, rows: DataFrame) -> DataFrame:
        return _with_margins(rows, self.features, [self.model])


def _with_margins(rows: DataFrame, features: list[str], boosted: list[Boosted], which: Column | None = None) -> DataFrame:
    """Rows with margin, prob and pred of the model of the number ``which`` (the first)."""
    @F.pandas_udf("double")
    def margin(number: pd.Series, x: pd.Series) -> pd.Series:
        out, values = np.zeros(len(x)), np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(features)))
        for m in number.unique():
            at = (number == m).to_numpy()
            out[at] = boosted[int(m)].margins(values[at])
        return pd.Series(out)

    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    scored = rows.withColumn("margin", margin((F.lit(0) if which is None else which).cast("int"), x))
    return scored.withColumn("prob", 1 / (1 + F.exp(-F.col("margin")))).withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def train_gbt(train: DataFrame, features: list[str], **settings) -> BoostedClassifier:
    """Second-order boosted trees on histograms, with leaf penalties and columns sampled per tree (see :mod:`booster`)."""
    return BoostedClassifier("gbt", features, fit_boosted(train, features, settings=Settings(**settings))[0], train.count())


def train_ablation(train: DataFrame, subsets: list[list[str]], **settings) -> list[BoostedClassifier]:
    """One boosted model per feature set, all grown in the same passes."""
    features = list(dict.fromkeys(f for subset in subsets for f in subset))
    n = train.count()
    return [BoostedClassifier("gbt", features, m, n) for m in fit_boosted(train, features, settings=Settings(**settings), subsets=subsets)]


def _assembler(features: list[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out)


def train_logistic(train: DataFrame, features: list[str], c: float = 1.0, max_iter: int = 1000) -> Classifier:
    """L2 logistic regression on features standardised by the training rows only.

    The objective 1/2|w|^2 + C*sum(loss) over population-standardised features is Spark's mean loss with
    regParam 1/(C*n), corrected by (n-1)/n because Spark's scaler divides by the sample deviation.
    """
    n = train.count()
    stages = [
        _assembler(features, "_x"),
        StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_z", labelCol="label", rawPredictionCol="_raw", probabilityCol="_prob",
                           predictionCol="_pred", regParam=(n - 1) / n / (c * n), elasticNetParam=0.0,
                           standardization=False, maxIter=max_iter, tol=1e-6),
    ]
    return Classifier("logistic", features, Pipeline(stages=stages).fit(train), n)


def train_spark_gbt(train: DataFrame, features: list[str], trees: int = 300, depth: int = 4, rate: float = 0.05,
                    rows: float = 0.8, columns: str = "0.8", seed: int = 42) -> Classifier:
    """Spark's own boosted trees: columns are sampled per node, there are no leaf penalties, and the rows that a tree
    samples depend on their partitions.

    Rows are gathered into partitions of at least about ``TREE_ROWS``: every level of every tree is a job over
    all of them, so small partitions cost more than they share out.
    """
    n = train.count()
    gathered = train.coalesce(max(1, min(train.rdd.getNumPartitions(), -(-n // TREE_ROWS))))
    stages = [
        _assembler(features, "_x"),
        GBTClassifier(featuresCol="_x", labelCol="label",
                      predictionCol="_pred", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
                      featureSubsetStrategy=columns, minInstancesPerNode=5, seed=seed, leafCol="_leaves")
        .setRawPredictionCol("_raw").setProbabilityCol("_prob"),
    ]
    return Classifier("spark_gbt", features, Pipeline(stages=stages).fit(gathered), n)


def fit(kind: str, train: DataFrame, features: list[str], **options) -> Classifier:
    return {"logistic": train_logistic, "gbt": train_gbt, "spark_gbt": train_spark_gbt}[kind](train, features, **options)


def date_positions(rows: DataFrame) -> DataFrame:
    """Add ``day`` (rank of the date among all dates) and ``days``. Splits of a pooled panel go by date,
    so no ticker trains on days after another ticker's test day. Equals row order for one ticker."""
    calendar = numbered(rows.select("date").distinct().withColumn("ticker", F.lit(ALL)))
    return rows.join(calendar.select("date", F.col("pos").alias("day"), F.col("n_rows").alias("days")), "date")


def split(rows: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    placed = date_positions(rows)
    train = F.col("day") < train_rows(F.col("days"), test_size)
    return placed.filter(train), placed.filter(~train)


def evaluate(scored: DataFrame) -> DataFrame:
    """accuracy, roc_auc, up_rate and n over all rows."""
    rows = scored.withColumns({"group": F.lit(ALL), "actual": F.col("label")})
    return metrics.scorecard(rows, ["group"]).drop("group")


def cross_validate(train: DataFrame, features: list[str], kind: str = "gbt", k: int = 3, **options) -> DataFrame:
    """Accuracy and AUC per expanding fold; the mean and population deviation ride along.

    Boosted trees of all folds share their passes; other kinds are fitted fold by fold.
    """
    placed = date_positions(train.drop("day", "days")).withColumn("fold", fold_of(F.col("day"), F.col("days"), k))
    out = None
    with cached(placed):
        if kind == "gbt":
            begins = placed.filter("fold > 0").groupBy("fold").agg(F.min("day").alias("day")).orderBy("fold").collect()  # k rows
            nested = fit_boosted(placed, features, [r["day"] for r in begins], settings=Settings(**options))
        for fold in range(1, k + 1):
            held = placed.filter(F.col("fold") == fold)
            if kind == "gbt":
                scored = _with_margins(held, features, [nested[fold - 1]])
            else:
                past = placed.filter(F.coalesce(F.col("fold"), F.lit(0)) < fold)
                scored = fit(kind, past, features, **options).score(held)
            row = evaluate(scored).withColumn("fold", F.lit(fold))
            out = row if out is None else out.unionByName(row)
        folds = out.select("fold", "n", "accuracy", "roc_auc").collect()  # k rows
    auc, acc = ([r[c] for r in folds] for c in ("roc_auc", "accuracy"))
    summary = [float(x) for x in (np.mean(auc), np.std(auc), np.mean(acc), np.std(acc))]
    return train.sparkSession.createDataFrame(
        [(*r, *summary) for r in folds],
        "fold int, n long, accuracy double, roc_auc double, auc_mean double, auc_std double, acc_mean double, acc_std double")


def walkforward_backtest(rows: DataFrame, features: list[str], kind: str = "logistic", initial: float = 0.5,
                         step: int = 21, min_train: int = 150, embargo: int = 0, parallel: int = 4,
                         **options) -> DataFrame:
    """Out-of-sample predictions: for every block of ``step`` days a model fitted on all earlier days.

    ``embargo`` leaves that many days before the block out of training (the labels look ahead). All
    logistic fits share their passes over the cached panel, and so do all boosters (kind ``gbt``).
    Returns the predictions table.
    """
    panel = date_positions(rows)
    with cached(panel):
        days = panel.agg(F.max("days")).first()[0] or 0
        starts = [at for at in range(int(days * initial), days, step) if at >= min_train]
        if not starts:
            raise ValueError("not enough history for one window")
        window = F.floor((F.col("day") - starts[0]) / F.lit(step)).cast("int")
        blocks = panel.filter(F.col("day") >= starts[0]).withColumn("window", window)
        if kind == "logistic":
            models = fit_nested(panel, features, [at - embargo for at in starts], **options)
            scored = blocks.join(models.table(panel).withColumnRenamed("model", "window"), "window")
            scored = scored.withColumn("prob", 1 / (1 + F.exp(-models.margin())))
        elif kind == "gbt":
            ends = [at - embargo for at in starts]
            nested = fit_boosted(panel, features, ends, settings=Settings(**options))
            sizes = panel.agg(*[F.coalesce(F.sum((F.col("day") < at).cast("long")), F.lit(0)) for at in ends]).first()
            scored = _with_margins(blocks, features, nested, F.col("window")).withColumn("train_size", F.array(*[F.lit(n) for n in sizes])[F.col("window")].cast("long"))
        else:
            def one(at: int) -> DataFrame:
                model = fit(kind, panel.filter(F.col("day") < at - embargo), features, **options)
                block = blocks.filter((F.col("day") >= at) & (F.col("day") < at + step))
                return model.score(block).withColumn("train_size", F.lit(model.train_size).cast("long"))

            with ThreadPoolExecutor(parallel) as pool:  # independent fits, a few at a time on the cached panel
                parts = list(pool.map(one, starts))
            while len(parts) > 1:  # pairwise, so the plan stays shallow
                parts = [x.unionByName(y) for x, y in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
            scored = parts[0]
    return scored.select(*KEY, "window", "train_size", "prob", F.col("label").alias("actual"),
                         (F.col("prob") > 0.5).cast("int").alias("pred"))


def platt_scale(model: Classifier, train: DataFrame, share: float = 0.2) -> Classifier:
    """Logistic regression on the raw score of the last ``share`` of the training days.

    With a model fitted on ``train`` the slice is part of its training data, as in the original method;
    pass a model fitted on the earlier days only to hold it out.
    """
    last = train.agg(F.max("day")).first()[0]
    recent = train.filter(F.col("day") > last - int((last + 1) * share))
    scored = model.score(recent).select("prob", "label")
    n = scored.count()
    stages = [
        VectorAssembler(inputCols=["prob"], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="label", rawPredictionCol="_raw", probabilityCol="_prob",
                           predictionCol="_pred", regParam=1.0 / n, standardization=False, maxIter=1000, tol=1e-8),
    ]
    with cached(scored):
        return Classifier("platt", ["prob"], Pipeline(stages=stages).fit(scored), n)


def calibrated(model: Classifier, platt: Classifier, rows: DataFrame) -> DataFrame:
    """Rows with the raw probability (``raw_prob``) and the calibrated one (``prob``)."""
    raw = model.score(rows).drop("margin", "pred")
    rest = [c for c in rows.columns]
    again = platt.model.transform(raw)
    return again.select(*rest, F.col("prob").alias("raw_prob"), vector_to_array("_prob")[1].alias("prob"))


def horizon_sweep(labelled: DataFrame, horizons: list[int], features: list[str],
                  test_size: float = 0.2) -> DataFrame:
    """Accuracy and AUC of the logistic model per horizon, from rows with one ``label_h`` per horizon.

    Each horizon has its own days, those with a label, of which the last ``test_size`` test. The models of all horizons
    are fitted in the same passes.
    """
    names = {h: f"label_{h}" for h in horizons}
    has = labelled.groupBy("date").agg(*[F.max(F.col(n).isNotNull().cast("int")).alias(n) for n in names.values()])
    w = Window.partitionBy(F.lit(ALL)).orderBy("date")  # a row per date: bounded by the calendar
    whole = Window.partitionBy(F.lit(ALL))
    train = {n: F.sum(n).over(w) - F.col(n) < F.floor(F.sum(n).over(whole) * (1 - test_size)) for n in names.values()}
    days = has.select("date", *[t.alias(f"_train_{n}") for n, t in train.items()])
    panel = labelled.select(*KEY, *features, *names.values()).join(days, "date")
    with cached(panel):
        own = panel.select(*features, *[F.when(F.col(f"_train_{n}"), F.col(n)).alias(n) for n in names.values()])
        model = fit_labels(own, features, list(names.values()))
        # A row per horizon that tests on it; the weights are constants.
        tests = F.explode(F.array_compact(F.array(*[
            F.when(~F.col(f"_train_{n}") & F.col(n).isNotNull(), F.struct(F.lit(h).alias("horizon"), F.col(n).alias("actual"), F.array(*map(F.lit, v)).alias("w")))
            for (h, n), v in zip(names.items(), model.raw_weights().tolist())])))
        scored = panel.withColumn("_t", tests).select(*features, "_t.*").withColumn("prob", 1 / (1 + F.exp(-model.margin())))
        scored = scored.select("horizon", "actual", "prob", (F.col("prob") > 0.5).cast("int").alias("pred"))
    return metrics.scorecard(scored, ["horizon"]).select("horizon", "accuracy", "roc_auc", "up_rate", F.col("n").alias("test_samples"))


def sentiment_verdict(both: DataFrame) -> DataFrame:
    """Gain of the feature set with sentiment over the base set, in words."""
    delta = F.col("auc_full") - F.col("auc_base")
    return both.withColumns({
        "auc_delta": delta, "accuracy_delta": F.col("accuracy_full") - F.col("accuracy_base"),
        "verdict": F.when(delta > 0.01, "MEANINGFUL").when(delta > 0, "MARGINAL").otherwise("NO IMPROVEMENT")})


def best_horizon(sweep: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("horizon", "roc_auc"), F.struct("roc_auc", -F.col("horizon")))
    return sweep.agg(best.alias("_b")).select("_b.*")


def coef_ranking(model: Classifier, rows: DataFrame) -> DataFrame:
    """Coefficients of the standardised features by size (one row per feature)."""
    pairs = list(zip(model.features, (float(w) for w in model.fitted.coefficients.toArray())))
    return rows.sparkSession.createDataFrame(pairs, "feature string, coefficient double").orderBy(
        F.desc(F.abs("coefficient")), "feature")
