"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import whole_text
from tapewise.llm.hashing import text_batches, word_hashes
from tapewise.llm.labelled import held_out, labelled_sample
from tapewise.sources import staging

GOOD = 0.7
#: Labelled documents that the field is fitted on, about, and their lines in all, at most. Each document has all its lines.
SAMPLE, LINES = 6000, 6000 * 64
STEPS, RATE, RIDGE = 200, 0.05, 1e-4

_CLASSES = np.zeros((8, 256), np.float32)  # letters, upper case, digits, !, |, other symbols, stops, spaces
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                               b"0123456789", b"!", b"|", b"#$%&*+=<>@^~_\\/{}[]", b".,;:?", b" \t")):
    _CLASSES[_row, list(_bytes)] = 1
FEATURES = 15


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines that are not empty, their bytes, lines per text)."""
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    sizes = np.array([len(d) + 1 for d in data])
    end = np.flatnonzero(raw == 10)
    begin = np.concatenate([[0], end[:-1] + 1])
    full = end > begin
    begin, end = begin[full], end[full]
    per_text = np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))
    n = (end - begin).astype(float)
    if not len(n):
        return np.zeros((0, FEATURES)), n, per_text
    counts = np.stack([np.add.reduceat(_CLASSES[k][raw], np.stack([begin, end], axis=1).ravel())[::2] for k in range(8)])
    letters, upper, digits, bangs, pipes, symbols, stops, spaces = counts.astype(float)
    # Words of each line: hashes of the texts' lines in the same order.
    lines = b"".join(data_ + b"\n" for data_ in data).decode().split("\n")
    hashes, words = word_hashes([x for x in lines if x])
    of = np.repeat(np.arange(len(n)), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    w = np.maximum(words, 1)
    x = np.stack([np.log1p(n), letters / n, upper / np.maximum(letters, 1), digits / n, np.minimum(bangs / w, 2), np.minimum(pipes / w, 2),
                  np.minimum(symbols / w, 4), np.minimum(stops / w, 2), np.minimum(n / w, 40), np.bincount(of, again, len(n)) / w,
                  np.bincount(of[order], new, len(n)) / w, np.log1p(words), _CLASSES[1][raw[begin]], _CLASSES[6][raw[end - 1]], spaces / n], axis=1)
    return x, n, per_text


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it, whether there is one, and a constant."""
    first = np.zeros(len(x), bool)
    last = np.zeros(len(x), bool)
    ends = np.cumsum(per_text)
    first[(ends - per_text)[per_text > 0]] = True
    last[ends[per_text > 0] - 1] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], axis=1)


def marginals(good: np.ndarray, per_text: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good), by forward-backward over all texts at once, and the expected numbers of transitions.

    ``good`` is each line's potential of being good (bad: 0), ``step`` the 2 x 2 potentials of neighbours.
    """
    order = np.argsort(-per_text, kind="stable")
    sizes, starts = per_text[order], (np.cumsum(per_text) - per_text)[order]
    most = int(sizes[0]) if len(sizes) else 0
    alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(most)]  # texts with more than t lines
    emit = np.exp(np.stack([np.zeros(len(good)), np.clip(good, -30, 30)], axis=1) - np.maximum(0, np.clip(good, -30, 30))[:, None])
    move, forward, backward = np.exp(step), np.zeros((len(good), 2)), np.ones((len(good), 2))
    for t in range(most):
        at = starts[:alive[t]] + t
        now = emit[at] * (forward[at - 1] @ move if t else 1.0)
        forward[at] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(most - 1, 0, -1):
        at = starts[:alive[t]] + t
        right = emit[at] * backward[at]
        joint = forward[at - 1][:, :, None] * move * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        left = right @ move.T
        backward[at - 1] = left / left.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


def _weighted_mean(good: np.ndarray, n: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    of = np.repeat(np.arange(len(per_text)), per_text)
    total = np.bincount(of, n, len(per_text))
    return np.where(total > 0, np.bincount(of, n * good, len(per_text)) / np.maximum(total, 1), 0.5)


class LineField:
    """The fitted field: scaling, line weights, transition potentials, and the curve from line share to P(label 1)."""

    def __init__(self, prior: float = 1.0):
        self.prior, self.weights = prior, None

    @classmethod
    def fit(cls, x: np.ndarray, n: np.ndarray, per_text: np.ndarray, label: np.ndarray) -> LineField:
        """From lines of labelled texts; a line gets its text's label. Without both labels the score is their share (1 without any)."""
        field = cls(float(label.mean()) if len(label) else 1.0)
        if len(np.unique(label)) < 2 or not len(x):
            return field
        field.mean, field.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        rows = with_neighbours(field._scaled(x), per_text)
        y = np.repeat(label, per_text).astype(float)
        of_pair = np.repeat(label, np.maximum(per_text - 1, 0))
        seen = np.diag([float((of_pair == 0).sum()), float((of_pair == 1).sum())])
        weights, step = np.zeros(rows.shape[1]), np.zeros((2, 2))
        moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(step), np.zeros_like(step)]
        for t in range(1, STEPS + 1):
            p, pairs = marginals(rows @ weights, per_text, step)
            slopes = ((y - p) @ rows / len(y) - RIDGE * weights, (seen - pairs) / len(y) - RIDGE * step)
            for value, slope, m, v in ((weights, slopes[0], *moments[:2]), (step, slopes[1], *moments[2:])):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope ** 2 - v)
                value += RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        field.weights, field.step = weights, step
        share = field._share(rows, n, per_text)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic curve with a small ridge
            p = 1 / (1 + np.exp(-(a * share + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((label - p) * share).sum() - 0.01 * a, (label - p).sum() - 0.01 * b])
            h = np.array([[(w * share * share).sum() + 0.01, (w * share).sum()], [(w * share).sum(), w.sum() + 0.01]])
            da, db = np.linalg.solve(h, g)
            a, b = a + np.clip(da, -5, 5), b + np.clip(db, -5, 5)
        field.curve = (float(a), float(b))
        return field

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def _share(self, rows: np.ndarray, n: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the lines' marginals, as log-odds; 0 for a text without lines."""
        mean = np.clip(_weighted_mean(marginals(rows @ self.weights, per_text, self.step)[0], n, per_text), 1e-3, 1 - 1e-3)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x, n, per_text = line_features(texts)
        return 1 / (1 + np.exp(-(self.curve[0] * self._share(with_neighbours(self._scaled(x), per_text), n, per_text) + self.curve[1])))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sum(1 for line in t.split("\n") if line) for t in texts], pa.int64())],
                                         names=["doc_id", "label", "lines"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        x, n, per_text = line_features(texts)
        ends = np.cumsum(per_text)
        kept = [slice(e - c, e) for e, c in zip(ends, per_text)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[k].tobytes() for k in kept], pa.binary()),
                                          pa.array([n[k].tobytes() for k in kept], pa.binary())], names=["doc_id", "label", "x", "n"])


def _within(known: list[dict], lines: int) -> list[int]:
    """Ids of documents in an order by hash, as many as have ``lines`` lines together, and at least the first of each label."""
    kept, seen, total, full = [], set(), 0, False
    for r in known:
        full = full or total + r["lines"] > lines
        if not full or not seen >= set(r["labels"]):
            kept.append(r["doc_id"])
            seen |= set(r["labels"])
            total += r["lines"]
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> LineField:
    """A field from about ``sample`` labelled documents at most, all lines of each.

    If these have more than ``lines`` lines together, it is fewer documents, by a hash of their id, never a part of one.
    """
    chosen = staging.written(labelled_sample(docs, labels, "quality", sample), "quality-sample")
    known = (chosen.mapInArrow(_counted, "doc_id long, label int, lines long").groupBy("doc_id")
             .agg(F.sum("lines").alias("lines"), F.collect_set("label").alias("labels"))
             .orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").toArrow().to_pylist())  # a row for each of the sample
    kept = _within(known, lines)
    if len(kept) < len(known):
        chosen = chosen.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")), "doc_id", "left_semi")
    got = chosen.mapInArrow(_features, "doc_id long, label int, x binary, n binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))
    x = [np.frombuffer(r["x"]).reshape(-1, FEATURES) for r in got]
    return LineField.fit(np.concatenate([np.zeros((0, FEATURES)), *x]), np.concatenate([np.zeros(0), *(np.frombuffer(r["n"]) for r in got)]),
                         np.array([len(r) for r in x], np.int64), np.array([r["label"] for r in got], float))


def _score(batches: Iterator[pa.RecordBatch], field: LineField) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(field.score(texts))], names=["doc_id", "score"])


def score(docs: DataFrame, field: LineField, least: float = GOOD) -> DataFrame:
    """doc_id, held_out, score (P of label 1) and predicted (1 from ``least`` on) of every whole text, null counting as empty.

    A text without lines that are not empty gets the score of the log-odds 0, or the share of good labels
    where the field could not be fitted. Rows of a null or repeated id are rows like others (a null id is never held
    out), further columns are left out, no rows give no rows.
    """
    rows = (docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .mapInArrow(partial(_score, field=field), "doc_id long, score double"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def _keep(batches: Iterator[pa.RecordBatch], field: LineField, least: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, column):
        yield batch.filter(pa.array(field.score(texts) >= least))


def keep_good(docs: DataFrame, field: LineField, least: float = GOOD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more; all of them if the field could not be fitted."""
    if field.weights is None:
        return docs
    return docs.mapInArrow(partial(_keep, field=field, least=least, column=docs.columns.index("text")), docs.schema)
