"""A Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from its root.

The leaves of each language, in order of their ids, form a binary tree; the roots of these trees, in order of the
languages, form another. A record of the store maps the digest of a node to the nodes BITS levels below it, so a
digit of a leaf's rank in base 2^BITS selects the next record on its path. Requests descend from the root: nodes
asked for at one depth meet the store by their digests, and all leaves below a node share its path, so no digest
is asked for once per leaf. What is not selected on a path are the siblings of its proof, top first; reversed
segment by segment they lead from the leaf to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.llm.common import SLICE_ROWS, slices
from tapewise.sources import staging

#: Levels of a tree between a record's node and its children.
BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The key of the tree of subroots; keys of languages are never empty.
TOP = ""


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """H over the values in turn: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key (of lang; in order of null first, then bytes), leaf, and tampered: the leaf with n_chars one more."""
    own = docs.select(F.col("doc_id").cast("long"), *(F.col(c) for c in FIELDS[1:]))
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit, leaf_digest(*(more if c == "n_chars" else F.col(c) for c in FIELDS)))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return own.select("doc_id", key.alias("key"), leaf_digest(*map(F.col, FIELDS)).alias("leaf"), changed.alias("tampered"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their rank from 0 and the number n of rows of their key, in order of ``order``; written.

    Rows are sorted by ranges, so a key of any size spreads over tasks, equal rows too; a small table of the rows per
    key and range turns positions into ranks.
    """
    sort = ["key", *order, "_tie"]
    spread = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    rows = staging.written(spread.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    table = rows.groupBy("key", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    table = table.select("key", "_part", shift.alias("_shift"), F.sum("_rows").over(Window.partitionBy("key")).alias("n"))
    return (rows.withColumn("_part", part).join(table, ["key", "_part"])
            .withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


# --- Building the store -----------------------------------------------------------------------------


def levels(children: list[str], steps: int) -> list[list[str]]:
    """The nodes of ``steps`` levels over ``children``, these first: each is H of two below it, the last one of what is left."""
    out = [children]
    for _ in range(steps):
        below = out[-1]
        out.append([sha(*below[k:k + 2]) for k in range(0, len(below), 2)])
    return out


def steps_over(n: int) -> int:
    """Levels over the nodes of one record, of n on its level in all: BITS, or as many as lead to one node."""
    return min(BITS, (n - 1).bit_length())


def records_over(n: int) -> int:
    """Records on the path to each of n leaves."""
    return -(-(n - 1).bit_length() // BITS) if n > 1 else 0


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, idx, n, children = (batch.column(c).to_pylist() for c in ("key", "idx", "n", "children"))
        digests = [levels(c, steps_over(m))[-1][0] for c, m in zip(children, n)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("idx"), pa.array([-(-m >> BITS) for m in n], pa.int64()),
                                          pa.array(digests), pa.array([steps_over(m) for m in n], pa.int32()), batch.column("children")],
                                         names=["key", "idx", "n", "digest", "steps", "children"])


def build(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The records over ``nodes`` (key, idx, n, digest), and each key's root (key, digest); ``most``: the largest n."""
    store, roots = [], [nodes.filter("n = 1").select("key", "digest")]
    for _ in range(records_over(most)):
        runs = nodes.filter("n > 1").groupBy("key", F.shiftright("idx", BITS).alias("idx"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        made = runs.select("key", "idx", "n", F.col("run.digest").alias("children"))
        made = staging.written(made.mapInArrow(_fold, "key string, idx long, n long, digest string, steps int, children array<string>"), "records")
        store.append(made.select("digest", "steps", "children"))
        nodes = made.select("key", "idx", "n", "digest")
        roots.append(nodes.filter("n = 1").select("key", "digest"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return store, found


# --- Descent ----------------------------------------------------------------------------------------


def siblings(above: list[list[str]], at: int) -> list[str]:
    """The siblings on the path from child ``at`` up: ``<`` or ``>`` for the side and the digest, empty for none."""
    out = []
    for nodes in above[:-1]:
        other = at ^ 1
        out.append(("<" if at & 1 else ">") + nodes[other] if other < len(nodes) else "")
        at >>= 1
    return out


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Selects each child of a record in turn: the path grows by the segment of those not selected, topmost first."""
    for batch in slices(batches, 16):
        out = []
        for row in batch.to_pylist():
            above = levels(row["children"], row["steps"])
            for at, child in enumerate(row["children"]):
                out.append((row["key"], (row["idx"] << BITS) + at, row["left"] - 1, row["subroot"], child, row["path"] + siblings(above, at)[::-1]))
        types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "idx", "left", "subroot", "digest", "path"])


def descend(requests: DataFrame, store: DataFrame) -> DataFrame:
    """The children (key, idx, left, subroot, digest, path) of the nodes asked for, found in the store by their digests."""
    found = requests.join(store, "digest").select("key", "idx", "left", "subroot", "path", "steps", "children")
    return found.mapInArrow(_descend, "key string, idx long, left int, subroot string, digest string, path array<string>")


def fold(node: str, path: list[str]) -> str:
    """The root over ``node`` by its siblings, lowest first."""
    for other in path:
        node = sha(node) if not other else sha(other[1:], node) if other[0] == "<" else sha(node, other[1:])
    return node


def _prove(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Proofs of the leaves below each record; rows come record by record, the record first."""
    above, up, subroot = [], [], ""
    for batch in slices(batches, SLICE_ROWS):
        out = []
        for row in batch.to_pylist():
            if row["rank"] is None:
                above, up, subroot = levels(row["children"], row["steps"]), row["path"][::-1], row["subroot"]
                continue
            at = row["rank"] & (1 << BITS) - 1
            if above[0][at] != row["leaf"]:
                raise RuntimeError("the descent led to another leaf")
            path = siblings(above, at) + up
            folded = fold(row["tampered"] or row["leaf"], path)
            out.append((row["doc_id"], row["leaf"], subroot, root, sha(*(p[1:] for p in path)), folded, folded == root))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 5, pa.bool_()))],
                                             names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row per row of ``docs``.

    leaf, subroot, root and the proof's siblings are those of the rows as they are; folded_root is worked out from
    the leaf, with n_chars one more where 7 divides the unsigned CRC-32 of the decimal doc_id, and the siblings.
    Null values have a digest of their own, a null lang is a language, null ids come first, rows of one id are in
    order of their leaves; a null n_chars or doc_id is never tampered with. Texts are hashed whole. Columns beyond
    the five are left out; no rows give no rows.
    """
    nodes = ranked(leaves(docs), "doc_id", "leaf")
    trees = staging.written(nodes.groupBy("key").agg(F.first("n").alias("n")), "trees")
    most, count = trees.agg(F.max("n"), F.count("*")).first()
    rows = nodes.select("key", F.shiftright("rank", BITS).alias("idx"), "rank", "doc_id", "leaf", "tampered")
    store, subroots = build(nodes.select("key", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest")), most or 0)
    subroots = staging.written(subroots.join(trees, "key").select(F.lit(TOP).alias("key"), F.col("key").alias("lang"), "digest", F.col("n").alias("leaves")), "subroots")
    ordered = staging.written(ranked(subroots, "lang"), "languages")
    more, top = build(ordered.select("key", F.col("rank").alias("idx"), "n", "digest"), count)
    for records in more:
        store.append(records)
    every = store[0] if store else None
    for records in store[1:]:
        every = every.unionByName(records)
    every = None if every is None else staging.written(every.dropDuplicates(["digest"]), "store")

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not count:
        return docs.sparkSession.createDataFrame([], schema)
    root = top.first()["digest"]
    ask = top.select(F.lit(TOP).alias("key"), F.lit(0).cast("long").alias("idx"), F.lit(records_over(count)).cast("int").alias("left"),
                     F.lit(None).cast("string").alias("subroot"), "digest", F.array().cast("array<string>").alias("path"))
    for _ in range(records_over(count)):
        ask = descend(ask, every)
    bits = F.length(F.bin(F.col("leaves") - 1))
    own = ordered.select(F.col("rank").alias("idx"), F.col("lang").alias("key"), F.when(F.col("leaves") > 1, F.ceil(bits / BITS)).otherwise(0).cast("int").alias("left"))
    ask = ask.select("idx", "digest", "path").join(own, "idx").select("key", F.lit(0).cast("long").alias("idx"), "left", F.col("digest").alias("subroot"), "digest", "path")
    last = ask.filter("left = 0").select("key", "idx", "subroot", "path", F.lit(0).alias("steps"), F.array("digest").alias("children"))
    for depth in range(records_over(most)):
        ask = ask if depth == 0 else staging.written(descend(ask.filter("left > 1"), every), "requests")
        last = last.unionByName(ask.filter("left = 1").join(every, "digest").select("key", "idx", "subroot", "path", "steps", "children"))
    both = rows.unionByName(last, allowMissingColumns=True).repartition("key", "idx").sortWithinPartitions("key", "idx", F.col("rank").asc_nulls_first())
    return both.mapInArrow(partial(_prove, root=root), schema)
