import hashlib
import random
import re

import numpy as np

from tapewise.llm import pii
from tapewise.llm.common import table
from tests.conftest import SMALL

SHAPES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for kind, shape in enumerate(SHAPES):
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, kind != 1 or all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")), kind != 2 or (12 <= len(digits) <= 19 and luhn(digits)), kind != 3 or 9 <= len(digits) <= 15)
            if all(good):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_shapes():
    rng = random.Random(2)
    texts = ["".join(rng.choice("a1@.-+() %4_b5:,9") for _ in range(120)) for _ in range(3000)]
    texts += ["".join(rng.choice("0123456789 .-+") for _ in range(80)) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "a@b.c@d.e", "256.1.1.1", "0255.1.1.1 +49-30-123456 tel", "1" * 5000 + ".1.1.1", "@@@ a@ @b.c"]
    for text in texts:
        assert sorted((s, k, e) for s, e, k, good in pii.candidates(text) if good) == base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+" * 200_000, "+1" + "(" * 300_000, "a@" * 150_000):
        pii.candidates(text)


def test_rows_of_the_given_table(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]] or "")
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [sum(w[1] == k for w in want) for k in range(4)] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.7, 0.5])
    cast = np.where(rng.random((4000, 6)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    cast[rng.random(cast.shape) < 0.2] = 0
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    p, tables = pii.reliabilities(patterns, np.zeros(len(patterns), int), counts.astype(float))
    known = {tuple(k): v for k, v in zip(patterns.tolist(), p)}
    guess = np.array([known[tuple(c)] for c in cast.tolist()]) > 0.5
    assert (guess == y).mean() > 0.93
    reliable = tables[1, :, 2] / (tables[1, :, 2] + tables[1, :, 0])
    assert reliable[0] > reliable[3] and abs(reliable[0] - 0.95) < 0.04


def test_the_method_adds_sure_spans_and_keeps_base_ones(spark):
    rng = random.Random(0)
    texts = ["write to: jo.%d@site%d.com now" % (k, k) for k in range(150)] + ["phone: +1 (2%02d) 555-0%03d please" % (k % 99, k) for k in range(150)]
    texts += ["phone: (2%02d) 555-0%03d please" % (k % 99, k) for k in range(40)] + ["email: jo%d [at] site.com" % k for k in range(40)]
    texts += ["order no %d%09d shipped" % (rng.randrange(10, 99), rng.randrange(10 ** 9)) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert all(rows[k]["n_email"] == 1 for k in range(150)) and all(rows[k]["n_phone"] == 1 for k in range(150, 300))
    added = [k for k, r in rows.items() if r["spans"] and not (r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"])]
    assert all(300 <= k < 380 for k in added)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    rows = pii.personal_data(odd_docs).collect()
    assert len(rows) == len(odd_rows) and {(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows if r["doc_id"] == 12} == {(1, 1, 1, 1)}
    assert pii.personal_data(no_docs).count() == 0
    clean = pii.redact(odd_docs)
    assert clean.schema == odd_docs.schema and clean.count() == len(odd_rows)
    assert {r["text"] for r in clean.filter("doc_id = 12").collect()} == {"mail <EMAIL> <PHONE>, <IP>, <CARD>"}
    assert clean.filter("text IS NULL").count() == 2 and pii.redact(no_docs).count() == 0
