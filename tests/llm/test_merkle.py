import hashlib
import zlib

import pytest

from tapewise.llm import merkle
from tapewise.llm.common import table
from tests.conftest import SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels from the leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted expected rows."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([n[2] for n in sorted(by[x], key=lambda n: n[:3])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, (*_, own, r) in enumerate(sorted(by[x], key=lambda n: n[:3])):
            proof, node = [], own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for levels, i in ((trees[x], at), (top, k)):
                for nodes in levels[:-1]:
                    run = nodes[i // 2 * 2:i // 2 * 2 + 2]
                    proof += [n for j, n in enumerate(run) if j != i % 2]
                    run[i % 2] = node
                    node, i = h(*run), i // 2
            out.append((r[0], own, trees[x][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(docs):
    return sorted(map(tuple, merkle.manifest(docs).collect()), key=repr)


def rows_of(docs):
    return [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]


def test_manifest_equals_brute_force_on_the_given_table(spark):
    docs = table(spark, SMALL, "documents")
    assert got(docs) == brute(rows_of(docs))


@pytest.mark.parametrize("bits", [1, 2, 3, 8])
@pytest.mark.parametrize("n", [1, 2, 3, 37, 300])
def test_records_of_any_width_give_the_same_proofs(bits, n, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", bits)
    leaves = [h(str(k)) for k in range(n)]
    whole = tree(leaves)
    for at in range(n):
        path, run, i, records = [], leaves, at, 0
        while len(run) > 1:
            above = [merkle.levels(run[k:k + (1 << bits)], merkle.steps_over(len(run))) for k in range(0, len(run), 1 << bits)]
            path += merkle.siblings(above[i >> bits], i & (1 << bits) - 1)
            run, i, records = [a[-1][0] for a in above], i >> bits, records + 1
        assert merkle.fold(leaves[at], path) == whole[-1][0] and records == merkle.records_over(n)
        assert [p[1:] for p in path if p] == [levels[i ^ 1] for levels, i in zip(whole, (at >> k for k in range(99))) if i ^ 1 < len(levels)]


def test_languages_of_one_leaf_many_levels_and_ties(spark):
    rows = [(k // 2, "s", "en", k % 3, "x") for k in range(700)] + [(1, None, None, None, None), (None, "s", "de", 4, ""), (None, "s", "de", 4, ""), (7, "é", "", 9, "ü\n")]
    rows += [(k, "s", f"lang{k}", 1, "one each") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert got(docs) == brute(rows)


def test_tampering_is_found_and_nothing_else(spark):
    rows = merkle.manifest(table(spark, SMALL, "documents")).collect()
    assert len({r["root"] for r in rows}) == 1
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) == (r["folded_root"] == r["root"])


def test_odd_rows(spark, odd_docs, no_docs):
    assert got(odd_docs) == brute(rows_of(odd_docs))
    assert got(no_docs) == [] and merkle.manifest(no_docs).columns == merkle.manifest(odd_docs).columns
    single = odd_docs.filter("doc_id = 1")
    row = merkle.manifest(single).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("")
