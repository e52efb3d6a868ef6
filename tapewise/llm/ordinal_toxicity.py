"""Toxicity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import whole_text
from tapewise.llm.hashing import mix, text_batches, word_hashes
from tapewise.llm.labelled import held_out, labelled_sample

#: Buckets of hashed features; those kept for the model; labelled documents that it is fitted on, about.
BUCKETS, KEPT, SAMPLE = 1 << 22, 4096, 12_000
#: A feature is kept if its share among toxic documents lies so many standard errors above, and is so many times, that among clean ones.
SIGNAL, LIFT = 4.0, 12.0
GRADES = 4
TOXIC = 0.5
STEPS, RATE, RIDGE = 400, 0.05, 5e-6
#: Besides the word, its first bytes: words of one stem share them.
PREFIXES = (4, 5, 7)

_GAPS = np.ones(256, bool)
_GAPS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def hashed_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every occurrence of a word or word beginning."""
    kinds = []
    for salt, prefix in enumerate((None, *PREFIXES)):
        hashes, per_text = word_hashes(texts, _GAPS, prefix)
        kinds.append((mix(hashes + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
    of = np.repeat(np.arange(len(texts)), per_text)
    return np.tile(of, len(kinds)), np.concatenate(kinds)


def _distinct(of: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = np.unique(of * buckets + bucket, return_counts=True)
    return keys // buckets, keys % buckets, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """P(grade > k) = sigmoid(w . x - cut_k): one weight vector for all thresholds, cuts in ascending order."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.kept, self.weights, self.cuts, self._table = kept, weights, cuts, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}  # a worker makes its own

    @property
    def table(self) -> np.ndarray:
        """The feature of each bucket, -1 for those not kept."""
        if self._table is None:
            self._table = np.full(BUCKETS, -1, np.int16)
            self._table[self.kept] = np.arange(len(self.kept))
        return self._table

    @classmethod
    def fit(cls, kept: np.ndarray, of: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray) -> OrdinalModel:
        n, k = len(grade), len(kept)
        weights, gaps = np.zeros(k), np.zeros(GRADES - 1)
        above = np.array([(grade > c).mean() for c in range(GRADES - 1)]).clip(1e-4, 1 - 1e-4)
        start = np.log((1 - above) / above)
        gaps[0], gaps[1:] = start[0], np.log(np.maximum(np.diff(start), 0.05))
        moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(gaps), np.zeros_like(gaps)]
        rows = np.arange(n)
        for t in range(1, STEPS + 1):
            cuts = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
            s = np.bincount(of, value * weights[feature], n)
            bounds = np.concatenate([np.full((n, 1), -40.0), cuts[None, :] - s[:, None], np.full((n, 1), 40.0)], axis=1)
            p, d = _sigmoid(bounds), _sigmoid(bounds) * _sigmoid(-bounds)
            likely = np.maximum(p[rows, grade + 1] - p[rows, grade], 1e-9)
            upper, lower = d[rows, grade + 1] / likely, d[rows, grade] / likely
            ds = lower - upper  # of the log-likelihood
            by_cut = np.array([upper[grade == c].sum() - lower[grade == c + 1].sum() for c in range(GRADES - 1)]) / n
            by_gap = np.concatenate([[by_cut.sum()], np.exp(gaps[1:]) * np.cumsum(by_cut[::-1])[::-1][1:]])
            slope = np.bincount(feature, value * ds[of], k) / n - RIDGE * weights
            for x, g, m, v in ((weights, slope, *moments[:2]), (gaps, by_gap, *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.001 * (g ** 2 - v)
                x += RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            np.maximum(weights, 0, out=weights)  # features speak for toxicity only
        return cls(kept, weights, gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))]))

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, feature, log count) of the features kept."""
        of, bucket = hashed_features(texts)
        known = self.table[bucket]
        at = np.flatnonzero(known >= 0)
        row, feature, count = _distinct(of[at], known[at].astype(np.int64), BUCKETS)
        return row, feature, np.log2(1 + count)

    def above(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        row, feature, value = self.features(texts)
        s = np.bincount(row, value * self.weights[feature], len(texts))
        return _sigmoid(s[:, None] - self.cuts[None, :])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch, texts in text_batches(batches):
        of, bucket = hashed_features(texts)
        row, bucket, _ = _distinct(of, bucket, BUCKETS)
        label = batch.column(2).to_numpy()[row]
        for c in (0, 1):
            np.add.at(counts[c], bucket[label == c], 1)
    some = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some].astype(np.int64)), pa.array(counts[1][some].astype(np.int64))], names=["bucket", "clean", "toxic"])


def _collected(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = OrdinalModel(kept, np.zeros(0), np.zeros(0))
    for batch, texts in text_batches(batches):
        row, feature, value = model.features(texts)
        start = np.searchsorted(row, np.arange(len(texts) + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2),
             pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(start, start[1:])], pa.binary()),
             pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(start, start[1:])], pa.binary())], names=["doc_id", "label", "feature", "value"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """A model from about ``sample`` labelled documents at most, or None unless both labels occur among them.

    Features are hashed words and word beginnings that are far more common in toxic documents; at most KEPT.
    Labels tell toxic from clean only. Grades are 0 for clean documents and 1 to 3 for thirds of the toxic
    ones by how many toxic features they have.
    """
    rows = labelled_sample(docs, labels, "toxic", sample).dropDuplicates(["text", "label"])  # a copied text counts once
    by_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = by_label.get(0, 0), by_label.get(1, 0)
    if not clean or not toxic:
        return None
    counts = rows.mapInArrow(_counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic") + 1) / (clean + toxic + 2)
    signal = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic))
    lifted = F.col("toxic") / toxic >= LIFT * (F.col("clean") + 0.5) / clean
    kept = (counts.filter(lifted).select("bucket", signal.alias("signal")).filter(F.col("signal") >= SIGNAL)
            .orderBy(F.desc("signal"), "bucket").limit(KEPT).toArrow())
    if not kept.num_rows:
        return None
    buckets = kept.column("bucket").to_numpy()
    got = rows.mapInArrow(partial(_collected, kept=buckets), "doc_id long, label int, feature binary, value binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["feature"]))
    feature = [np.frombuffer(r["feature"], np.int32) for r in got]
    value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in got]).astype(float)
    of, label = np.repeat(np.arange(len(got)), [len(f) for f in feature]), np.array([r["label"] for r in got])
    feature = np.concatenate(feature)
    amount = np.bincount(of, value, len(got))
    edges = np.quantile(amount[label == 1], np.linspace(0, 1, GRADES)[1:-1])
    grade = np.where(label == 1, 1 + np.searchsorted(edges, amount, "right"), 0)
    return OrdinalModel.fit(buckets, of, feature, value, grade)


def _grade(batches: Iterator[pa.RecordBatch], model: OrdinalModel | None) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        above = model.above(texts) if model else np.zeros((len(texts), GRADES - 1))
        grades = np.diff(np.concatenate([np.zeros((len(texts), 1)), 1 - above, np.ones((len(texts), 1))], axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(np.argmax(grades, axis=1).astype(np.int32))],
                                         names=["doc_id", "score", "expected_severity", "severity"])


def grade(docs: DataFrame, model: OrdinalModel | None, least: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score (P of any toxicity), expected_severity (0 to 3), severity (the likeliest grade) and predicted (0 or 1).

    Every whole text counts, a null one as empty; rows of a null or repeated id are rows like others, further columns
    are left out, no rows give no rows. Without a model all scores are 0.
    """
    rows = (docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .mapInArrow(partial(_grade, model=model), "doc_id long, score double, expected_severity double, severity int"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", "expected_severity", "severity", (F.col("score") >= least).cast("int").alias("predicted"))


def _keep(batches: Iterator[pa.RecordBatch], model: OrdinalModel | None, least: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, column):
        yield batch.filter(pa.array(model.above(texts)[:, 0] < least)) if model else batch


def keep_clean(docs: DataFrame, model: OrdinalModel | None, least: float = TOXIC) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted to be toxic.

    A null text is empty and stays; ids, and columns of any name, do not matter. Without a model all rows stay.
    """
    return docs.mapInArrow(partial(_keep, model=model, least=least, column=docs.columns.index("text")), docs.schema)
