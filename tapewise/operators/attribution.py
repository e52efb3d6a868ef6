"""Additive feature contributions in log-odds: they and the base value sum to the margin."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.operators.explain import contribution_array, top_features
from tapewise.operators.models import Classifier
from tapewise.operators.trees import Shapley, of_spark
from tapewise.functions.scalar import confidence_bucket


def linear_attribution(model: Classifier, rows: DataFrame) -> DataFrame:
    """coef * (x - mean) / deviation per feature; the base value is the intercept (features are centred)."""
    scaler, fitted = model.model.stages[1], model.fitted
    coef, mean, dev = fitted.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray()
    parts = [F.lit(float(w / d if d else 0.0)) * (F.col(f) - F.lit(float(m)))
             for f, w, m, d in zip(model.features, coef, mean, dev)]
    return model.score(rows).withColumns({
        "base_value": F.lit(float(fitted.intercept)), "parts": F.array(*parts)})


def _shapley(model: Classifier) -> Shapley:
    """Of the log-odds: twice the weighted sum of the trees of a Spark model, the plain sum of a booster's."""
    if model.kind == "gbt":
        return Shapley(model.model.trees, [1.0] * len(model.model.trees), len(model.features))
    fitted = model.fitted
    trees = [of_spark(t) for t in fitted._java_obj.trees()]
    return Shapley(trees, [2.0 * w for w in fitted.treeWeights], len(model.features))


def tree_attribution(model: Classifier, rows: DataFrame) -> DataFrame:
    """Shapley values of the log-odds, exact for the model's trees and the rows they were grown on.

    The model's paths are a constant of trees x leaves x 2^depth numbers, whatever the data; each Arrow batch looks up
    which path every row passes and sums. Rows with NaN features go right at each split, as in the model.
    """
    shapley = _shapley(model)

    @F.pandas_udf("array<double>")
    def add_up(x: pd.Series) -> pd.Series:
        return pd.Series(list(shapley.values(np.stack(x.to_numpy()).astype(float)))) if len(x) else pd.Series([], dtype=object)

    scored = model.score(rows)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in model.features])
    return scored.withColumns({"base_value": F.lit(shapley.base), "parts": add_up(x)})


def attribute(model: Classifier, rows: DataFrame) -> DataFrame:
    """prob, margin, base_value and the contribution structs of every row."""
    out = (linear_attribution if model.kind == "logistic" else tree_attribution)(model, rows)
    structs = contribution_array(model.features, [F.col(f) for f in model.features],
                                 [F.col("parts")[i] for i in range(len(model.features))])
    return out.withColumn("contributions", structs)


def score_latest(model: Classifier, latest: DataFrame, horizon: int = 10) -> DataFrame:
    """One analysis row per ticker: probabilities, confidence, five strongest contributions, base value."""
    out = attribute(model, latest)
    prob = F.round("prob", 4)
    return out.select(
        "ticker", "date", prob.alias("prob_up"), F.round(1 - F.col("prob"), 4).alias("prob_down"),
        confidence_bucket(F.col("prob")).alias("confidence"), top_features(F.col("contributions")).alias("top_features"),
        F.round("base_value", 4).alias("base_rate"), F.lit(model.train_size).cast("long").alias("training_samples"),
        F.lit(horizon).alias("horizon_days"))
