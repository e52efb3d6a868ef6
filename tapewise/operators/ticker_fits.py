"""One logistic model per ticker, all fitted together by distributed Newton steps.

A ticker's training rows are cut into blocks of bounded size. In each step every block adds its part of its
ticker's gradient and Hessian, Spark sums the parts, and each ticker solves one small system. No task holds a
ticker, no ticker is treated by its size, and neither rows nor models pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.operators.features import train_rows
from tapewise.operators.panel import numbered
from tapewise.sources import staging

KEY = ["ticker", "date"]
BLOCK_ROWS = 2048
#: Blocks of a ticker that meet its weights in one task, at most.
SLOT_BLOCKS = 16


def _blocks(train: DataFrame, features: list[str]) -> DataFrame:
    """(ticker, slot, x, y): the raw features and labels of consecutive rows, as bytes of doubles; few blocks share a slot."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        return pd.DataFrame({"ticker": [group["ticker"].iloc[0]], "slot": [group["part"].iloc[0] // SLOT_BLOCKS], "x": [group[features].to_numpy(float).tobytes()],
                             "y": [group["label"].to_numpy(float).tobytes()]})

    cut = train.select("ticker", "pos", *features, "label", F.floor(F.col("pos") / BLOCK_ROWS).alias("part"))
    return cut.groupBy("ticker", "part").applyInPandas(one, "ticker string, slot long, x binary, y binary")


def _sums(joined: DataFrame, width: int) -> DataFrame:
    """(ticker, total): gradient and Hessian of the mean-free loss at the weights that ride along."""
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for x, y, mean, dev, w in zip(frame["x"], frame["y"], frame["mean"], frame["dev"], frame["w"]):
                raw = np.frombuffer(x).reshape(-1, width)
                a = np.hstack([(raw - mean) / dev, np.ones((len(raw), 1))])
                p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -500, 500)))
                hessian = (a * (p * (1 - p))[:, None]).T @ a
                parts.append(np.r_[a.T @ (p - np.frombuffer(y)), hessian.ravel()])
            yield pd.DataFrame({"ticker": frame["ticker"], "part": parts})

    parts = joined.mapInPandas(task, "ticker string, part array<double>").select("ticker", F.posexplode("part").alias("k", "v"))
    cells = parts.groupBy("ticker", "k").agg(F.sum("v").alias("v"))
    ordered = cells.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("cells"))  # as many as the model has
    return ordered.select("ticker", F.transform("cells", lambda c: c["v"]).alias("total"))


def _solved(state: DataFrame, sums: DataFrame, width: int, c: float) -> DataFrame:
    ridge = np.r_[np.ones(width), 0.0] / c

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            moved = []
            weights = []
            for w, total in zip(frame["w"], frame["total"]):
                w, total, d = np.asarray(w), np.asarray(total), width + 1
                hessian = total[d:].reshape(d, d) + np.diag(ridge) + 1e-12 * np.eye(d)
                move = np.linalg.solve(hessian, total[:d] + ridge * w)
                weights.append(w - move)
                moved.append(float(np.abs(move).max()))
            yield frame.drop(columns=["total"]).assign(w=weights, moved=moved)

    kinds = "ticker string, train_size long, mean array<double>, dev array<double>, w array<double>, moved double"
    return state.join(sums, "ticker").select(*state.columns, "total").mapInPandas(task, kinds)


def per_ticker_models(rows: DataFrame, features: list[str], test_size: float = 0.2, c: float = 1.0, steps: int = 50,
                      tolerance: float = 1e-9) -> DataFrame:
    """Prediction for the last row of every ticker by a model of its own, fitted on its first rows.

    ticker, date, prob_up, train_size and converged. The objective is 1/2|w|^2 + c*sum(loss) over features
    standardised by the training rows. Where all training labels are equal the label is the prediction;
    without training rows it is null. Rows with a null ticker or date take no part.
    """
    width = len(features)
    known = rows.select(*KEY, *features, "label").dropna(subset=KEY)
    panel = staging.written(numbered(known).withColumn("cut", train_rows(F.col("n_rows"), test_size)), "ticker-panel")
    train = panel.filter("pos < cut")
    mean, dev = F.array(*[F.avg(f) for f in features]), F.array(*[F.stddev_pop(f) for f in features])
    stats = staging.written(train.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("train_size"), F.avg("label").alias("share"), mean.alias("mean"),
        F.transform(dev, lambda x: F.when(x == 0, 1.0).otherwise(x)).alias("dev")), "ticker-moments")
    blocks = staging.written(_blocks(train, features), "ticker-blocks")
    # The weights of a ticker go to each of its slots, so that its blocks, however many, meet them in many tasks.
    slots = staging.written(blocks.select("ticker", "slot").distinct(), "ticker-slots")
    state = stats.filter("share > 0 AND share < 1").select("ticker", "train_size", "mean", "dev", F.array_repeat(F.lit(0.0), width + 1).alias("w"),
                                                         F.lit(1.0).alias("moved"))
    done = None
    for _ in range(steps):
        spread = state.select("ticker", "mean", "dev", "w").join(slots, "ticker")
        sums = _sums(blocks.join(spread, ["ticker", "slot"]).select("ticker", "x", "y", "mean", "dev", "w"), width)
        state = staging.written(_solved(state, sums, width, c), "ticker-weights")
        finished = state.filter(F.col("moved") < tolerance)
        done = finished if done is None else done.unionByName(finished)
        state = state.filter(F.col("moved") >= tolerance)
        if state.isEmpty():
            break
    models = done.withColumn("converged", F.lit(True)).unionByName(state.withColumn("converged", F.lit(False)))
    x = F.transform(F.arrays_zip(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col("mean").alias("m"), F.col("dev").alias("d")),
                    lambda z: (z["x"] - z["m"]) / z["d"])
    margin = F.aggregate(F.zip_with(F.concat(x, F.array(F.lit(1.0))), "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    last = panel.filter("pos = n_rows - 1").join(stats.select("ticker", "train_size", "share"), "ticker", "left")
    scored = last.join(models.drop("train_size", "moved"), "ticker", "left").withColumn("margin", margin)
    return scored.select(
        *KEY, F.when(F.col("share").isin(0.0, 1.0), F.col("share")).otherwise(1 / (1 + F.exp(-F.col("margin")))).alias("prob_up"),
        F.coalesce("train_size", F.lit(0)).alias("train_size"), F.coalesce("converged", F.lit(True)).alias("converged"))
