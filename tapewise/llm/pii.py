"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import whole_text
from tapewise.llm.hashing import text_batches
from tapewise.sources import staging

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Possessive runs, and no start inside a run of digits: the same matches, without trying each digit of a long run.
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELT_AT = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?[\[(](?:at|AT)[\])] ?([A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}){1,4})")

#: Gazetteers: top-level domains, issuers' first digits, calling codes.
DOMAINS = frozenset("com org net edu gov mil int info biz io dev app eu de fr es it uk us ca au nl ch at be pl pt se no dk fi jp cn in br mx ru".split())
ISSUERS = ("34", "35", "36", "37", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "65", "7", "81", "82", "86", "90", "91", "351", "353", "358")
SPEAKS_FOR = {
    "email": re.compile(r"(?:e-?mails?|contact|kontakt|contacto|courriel|correo|write to|reach)\W*$", re.I),
    "ip": re.compile(r"(?:\bip|address|adresse|host|server|client|from|login)\W*$", re.I),
    "card": re.compile(r"(?:card|credit|visa|master|amex|karte|carte|tarjeta|account|payment)\W*(?:no\.?|number|nr\.?)?\W*$", re.I),
    "phone": re.compile(r"(?:phone|tel|call|fax|mobile|cell|telefon|t[ée]l[ée]phone|tel[ée]fono|dial|ring|sms|whatsapp)\W*(?:no\.?|number|nr\.?)?\W*$", re.I),
}
SPEAKS_AGAINST = re.compile(r"(?:isbn|issn|version|release|order|invoice|ticket|serial|part|page|build|patent|section|doi|id)\W*(?:no\.?|number|nr\.?)?\W*$", re.I)
CONTEXT = 40
LABELERS = 6
#: Spans that the final classifier is fitted on, about, and the probability from which it adds one.
SAMPLE, SURE = 20_000, 0.9


def _email(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def _is_ip(span: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in span.split("."))


def _is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and _luhn(digits)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, base) of all spans that a kind's shape fits, by start and kind; base ones pass its check."""
    found = [(s, e, 0, True) for s, e in _email(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        found += [(*m.span(), 0, False) for m in SPELT_AT.finditer(text)]
    found += [(*m.span(), 1, _is_ip(m[0])) for m in QUAD.finditer(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 9:
            digits = _digits(m[0])
            if _is_card(digits):
                found.append((*m.span(), 2, True))
            elif 9 <= len(digits) <= 19:
                found.append((*m.span(), 2 if len(digits) > 15 or len(digits) >= 12 and len(digits) == len(m[0]) else 3, False))
    if "+" in text:
        found += [(*m.span(), 3, 9 <= len(_digits(m[0])) <= 15) for m in DIALLED.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return found


def votes(text: str, start: int, end: int, kind: int, base: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for no opinion."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + 1]
    if name == "email":
        last = re.split(r"\W", span.rstrip(")]"))[-1].lower()
        valid, listed = (1 if base else 0), (1 if last in DOMAINS else -1)
    elif name == "ip":
        first = span.split(".")[0].lstrip("0")[:4]
        valid, listed = (1 if base else -1), (-1 if first in ("", "127", "255") else 0)
    elif name == "card":
        valid, listed = (1 if base else -1), (1 if digits.startswith(ISSUERS) else -1)
    else:
        valid, listed = (1 if 10 <= len(digits) <= 13 else -1), (1 if span.startswith("+") and digits.startswith(CODES) else 0)
    context = -1 if SPEAKS_AGAINST.search(before) else 1 if SPEAKS_FOR[name].search(before) else 0
    glued = (before[-1:].isalnum() or before[-1:] in ("_", "=", "/", "#", "$", "€")) or (after.isalnum() or after in ("_", "=", "/", "%"))
    steps = {ord(b) - ord(a) for a, b in zip(digits, digits[1:])}
    plain = 0 if name in ("email", "ip") else (-1 if len(set(digits)) <= 2 or len(steps) == 1 else 1)
    return (1 if base else -1, valid, listed, context, -1 if glued else 1, plain)


def span_features(text: str, start: int, end: int, kind: int, cast: tuple[int, ...]) -> list[float]:
    span = text[start:end]
    n = len(_digits(span))
    return [1.0, *map(float, cast), *(float(kind == k) for k in range(len(KINDS))), n / 10, len(span) / 20, sum(c in " -.()" for c in span) / 5]


FEATURES = 1 + LABELERS + len(KINDS) + 3


def reliabilities(pattern: np.ndarray, kind: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(P(personal data) of each pattern of votes, P(vote | class) by class, labeler and vote + 1).

    Expectation-maximisation with labelers that err independently given the class, and a prior for each
    kind; it starts from the sum of votes, so class 1 is the one the labelers speak for.
    """
    p = 1 / (1 + np.exp(-pattern.sum(axis=1).astype(float)))
    table = np.full((2, LABELERS, 3), 1 / 3)
    for _ in range(rounds):
        share = np.stack([1 - p, p]) * weight
        prior = np.array([(share[1][kind == k].sum() + 1) / (weight[kind == k].sum() + 2) for k in range(len(KINDS))])[kind]
        for v in (-1, 0, 1):
            table[:, :, v + 1] = share @ (pattern == v) + 1
        table /= table.sum(axis=2, keepdims=True)
        each = np.log(table[:, np.arange(LABELERS)[None, :], pattern + 1]).sum(axis=2)
        now = 1 / (1 + np.exp(np.clip(each[0] - each[1] + np.log((1 - prior) / prior), -50, 50)))
        if np.abs(now - p).max(initial=0) < 1e-9:
            break
        p = now
    return p, table


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


CAST = "array<struct<start:int,end:int,kind:int,base:boolean,votes:array<int>,features:array<double>>>"
_CAST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float64()))]))


def _examined(text: str) -> list[dict]:
    out = []
    for start, end, kind, base in candidates(text):
        cast = votes(text, start, end, kind, base)
        out.append({"start": start, "end": end, "kind": kind, "base": base, "votes": list(cast), "features": span_features(text, start, end, kind, cast)})
    return out


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_examined(t) for t in texts], _CAST)], names=["doc_id", "spans"])


def examine(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of every whole text (null: empty), with their votes and features."""
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_examine, f"doc_id long, spans {CAST}")


def fit(examined: DataFrame) -> np.ndarray | None:
    """Weights of the span classifier; None if there is no candidate.

    The labelers' reliabilities come from the numbers of all vote patterns in all documents, of which there
    are at most kinds x 3^labelers. The classifier learns the resulting probabilities on about SAMPLE spans.
    """
    spans = examined.select(F.explode("spans").alias("s")).select("s.*")
    counted = spans.groupBy("kind", "votes").count().toArrow().to_pylist()
    if not counted:
        return None
    counted.sort(key=lambda r: (r["kind"], r["votes"]))
    pattern, kind = np.array([r["votes"] for r in counted]), np.array([r["kind"] for r in counted])
    p, _ = reliabilities(pattern, kind, np.array([r["count"] for r in counted], float))
    known = {(r["kind"], tuple(r["votes"])): x for r, x in zip(counted, p)}
    n = sum(r["count"] for r in counted)
    rows = examined.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    if n > SAMPLE:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "start", "end", "kind"), F.lit(-(-n // SAMPLE))) == 0)
    rows = rows.select("kind", "votes", "features").toArrow().to_pylist()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    return _logistic(np.array([r["features"] for r in rows]), np.array([known[r["kind"], tuple(r["votes"])] for r in rows]))


def decide(spans: list[dict], weights: np.ndarray | None, sure: float = SURE) -> list[tuple[int, int, int, bool]]:
    """Base spans, and those others that the classifier is sure of and that overlap no span taken before; by start and kind."""
    taken = [(s["start"], s["end"], s["kind"], True) for s in spans if s["base"]]
    starts = [t[0] for t in taken]
    reach = np.maximum.accumulate([0, *(t[1] for t in taken)]).tolist()  # the furthest end of the first so many base spans
    done = 0
    for s in spans:
        if not s["base"] and weights is not None and s["start"] >= done:
            before = bisect.bisect_left(starts, s["end"])  # base spans that start before this one ends
            if reach[before] <= s["start"] and np.dot(weights, s["features"]) >= np.log(sure / (1 - sure)):
                taken.append((s["start"], s["end"], s["kind"], False))
                done = s["end"]
    return sorted(taken, key=lambda x: (x[0], x[2]))


def _written(spans: list[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind, _ in spans)


def _resolve(batches: Iterator[pa.RecordBatch], weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans in batch.column(1).to_pylist():
            chosen = decide(spans, weights)
            base = [s for s in chosen if s[3]]
            counts = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(chosen)))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of base spans, and all spans as kind:start:end.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans; rows with null or
    repeated doc_id are rows like others. Base spans are the shapes' leftmost matches that pass their checks;
    the classifier adds spans that only resemble them.
    """
    examined = staging.written(examine(docs), "examined")
    return examined.mapInArrow(partial(_resolve, weights=fit(examined)),
                               "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, weights: np.ndarray | None) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    parts, done = [], 0
    for start, end, kind, _ in decide(_examined(text), weights):
        if start >= done:
            parts += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(parts) + text[done:] if parts else text


def _redact(batches: Iterator[pa.RecordBatch], weights: np.ndarray | None, column: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, column):
        new = [redacted(t, weights) for t in texts]
        null = batch.column(column).is_null().to_pylist()
        columns = [*batch.columns]
        columns[column] = pa.array([None if gone else t for t, gone in zip(new, null)], pa.string())
        if size >= 0:
            before = batch.column(size)
            changed = pa.array([a != b for a, b in zip(texts, new)], pa.bool_())
            columns[size] = pa.compute.if_else(changed, pa.array([len(t) for t in new], before.type), before)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in its texts replaced; n_chars, if there, follows where a text changed.

    Every row stays, with all its columns: null texts stay null, rows of null or repeated ids are rows like others.
    """
    weights = fit(staging.written(examine(docs), "examined"))
    names = docs.columns
    return docs.mapInArrow(partial(_redact, weights=weights, column=names.index("text"), size=names.index("n_chars") if "n_chars" in names else -1), docs.schema)
