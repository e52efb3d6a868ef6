import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tapewise.llm import turns
from tapewise.llm.common import table
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """conv_id -> its rows (turn, role, text) after damage, in order."""
    out = {}
    for conv_id, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        of = out.setdefault(conv_id, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        of += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def brute(rows):
    """The contract's columns of one conversation, by trying every edit."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.sub("[\x20\x09-\x0d]+$", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(k, shape, inserts):
        """(cost, edits, made rows) from row k on, behind made initials of this shape: "", "s", "u" or "a"."""
        found = []
        if k == len(rows):
            if shape in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[k]
            extra = 5 if faults[k] == "truncated" else 0
            steps = [("D", 2, shape, None)]
            if faults[k] not in ("blank", "duplicate"):
                new = "a" if shape == "u" else "u"
                steps.append(("R", 1 + extra, new, ("user" if new == "u" else "assistant", text)))
                i = role[:1]
                if not i or i == new or i == "s" and shape == "":
                    steps.append(("K", extra, i or shape, (role, text)))
            for letter, cost, after, made in steps:
                rest = best(k + 1, after, 0)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], ((made,) if made else ()) + rest[2]))
        if inserts < 2:
            new = "a" if shape == "u" else "u"
            rest = best(k, new, inserts + 1)
            if rest:
                found.append((5 + rest[0], "I" + rest[1], (("user" if new == "u" else "assistant", ""),) + rest[2]))
        return min(found, key=lambda f: f[:2]) if found else None

    cost, audit, made = best(0, "", 0)
    known = [t for t, _, _ in rows if t is not None]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def check(rows, docs, **options):
    got = {r[0]: tuple(r)[1:] for r in turns.repair(turns.damage(docs), **options).collect()}
    want = {c: brute(v) for c, v in damaged(rows).items()}
    assert got == want
    return got


def noisy(rng, conv_id, n, ids=range(10 ** 6)):
    roles, texts = ["user", "assistant", "system", "tool", "", "unknown", None, "user", "assistant"], ["Yes.", "no", " \n", "", "What?", None, "a.b", "end!\t", "é"]
    return [(conv_id, rng.choice([k, k, k, k // 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.") for k in range(n)]


def test_costs_and_edits_equal_every_repair():
    rng = random.Random(1)
    for block in (1, 3, 4):
        tables = turns.BlockTables(block)
        for _ in range(300):
            rows = [(k, rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["", "yes.", "no", "so!", f"{k}?"])) for k in range(rng.randrange(13))]
            seen, symbols = set(), bytearray()
            for _, role, text in rows:
                symbols.append(0 if (role, text) in seen else turns.symbol_of(role, text))
                seen.add((role, text))
            want = brute(tuple(rows))
            assert tables.solve(bytes(symbols)) == want[5:7]


def test_conversations_on_the_given_table(spark):
    docs = table(spark, SMALL, "conversations")
    got = check([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()], docs)
    assert sum(r[5] for r in got.values()) > 0


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_segments_of_any_size_give_the_same_result(spark, size):
    rng = random.Random(size)
    rows = [r for c in [None, *range(25)] for r in noisy(rng, c, rng.randrange(1, 14))] + noisy(rng, 77, 400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(rows, docs, segment_rows=size)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", ""), (1, None, "user", ""), (2, 5, "", "Kept."), (2, 5, "", "Kept."), (3, -(2 ** 62), "user", "x" * 40_000 + "."),
            (3, 2 ** 62, "assistant", "x" * 40_000), (4, 1, "user", "."), (4, 1, "user", "."), (5, 0, "system", "Only.")]
    rows += [(k, k, "user", "Gone?") for k in range(100, 140)]  # some lose all their rows
    docs = spark.createDataFrame([(*r, 7, "b") for r in rows], SCHEMA + ", segment long, audit string").repartition(2)
    got = check(rows, docs)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    empty = turns.repair(turns.damage(docs.limit(0)))
    assert empty.columns == list(turns.RESULT) and empty.count() == 0
