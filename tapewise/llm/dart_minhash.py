"""Near-duplicates by DartMinHash: darts thrown at the regions under weighted shingles, the earliest per coordinate kept."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import attempt, whole_text
from tapewise.llm.hashing import M1, M2, STEP, mix, nth, text_batches, word_hashes
from tapewise.sources import staging

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 30, 5

#: P(a unit cell holds at most n darts), n = 0, 1, ...: one dart is expected in each.
_AT_MOST = np.exp(-1.0) * np.cumsum(1 / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 18.0)])))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0 ** -53


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of ``counts``."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def shingle_bags(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times it occurs), sorted by both. A text of 1 to ``words`` - 1 words is one shingle."""
    hashes, per_text = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), per_text)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    left = np.repeat(np.cumsum(per_text), per_text) - np.arange(len(hashes))  # words of the text from here on
    sums = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        sums += np.where(left > k, mix(padded[k:k + len(hashes)] + nth(k + 1)), np.uint64(0))
    keep = (left >= words) | ((_within(per_text) == 0) & (np.repeat(per_text, per_text) < words))
    of, sums = of[keep], mix(sums[keep])
    order = np.lexsort((sums, of))
    of, sums = of[order], sums[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (sums[1:] != sums[:-1])
    at = np.flatnonzero(first)
    return of[at], sums[at], np.diff(np.append(at, len(of)))


def _darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts that hit the area under each weight and below each rank limit: (row, dart, rank).

    The plane over an element is cut into regions whose sides double: weights from 2^a - 1 to 2^(a+1) - 1,
    ranks likewise. Unit cells of a region get a Poisson number of darts from a hash of the element and the
    cell, so a dart is the same for every set that it hits, whatever that set's weight and limit.
    """
    found = []
    for a in count():
        heavy = np.flatnonzero(weight > 2.0 ** a - 1)
        if not len(heavy):
            break
        for b in count():
            rows = heavy[limit[heavy] > 2.0 ** b - 1]
            if not len(rows):
                break
            wide = np.ceil(np.minimum(weight[rows] - (2.0 ** a - 1), 2.0 ** a)).astype(np.int64)
            high = np.ceil(np.minimum(limit[rows] - (2.0 ** b - 1), 2.0 ** b)).astype(np.int64)
            cells = wide * high
            k, of, tall = _within(cells), np.repeat(rows, cells), np.repeat(high, cells)
            x, y = k // tall, k % tall
            seed = mix(element[of] + mix(((x << 32) | y).astype(np.uint64) + nth((a << 8 | b) + 1)))
            n = np.searchsorted(_AT_MOST, _unit(seed))
            some = np.flatnonzero(n)
            n = n[some]
            pick = np.repeat(some, n)
            dart = mix(seed[pick] + (_within(n) + 1).astype(np.uint64) * STEP)
            across, up = _unit(mix(dart ^ M1)), _unit(mix(dart ^ M2))
            row, rank = of[pick], 2.0 ** b - 1 + y[pick] + up
            hit = (2.0 ** a - 1 + x[pick] + across < weight[row]) & (rank < limit[row])
            found.append((row[hit], dart[hit], rank[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def signatures(of: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, size: int) -> np.ndarray:
    """The earliest dart in each of ``size`` coordinates, for each of ``sets`` weighted sets; 0 for a set without weight.

    So many darts are expected that few coordinates stay empty; sets with an empty one throw twice as many.
    Two sets agree in a coordinate with a probability equal to their weighted Jaccard similarity.
    """
    out = np.zeros((sets, size), np.uint64)
    total = np.bincount(of, weight, sets)
    darts = size * (np.log(size) + 2)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        number = np.full(sets, -1)
        number[todo] = np.arange(len(todo))
        rows = np.flatnonzero(number[of] >= 0)
        own = number[of[rows]]
        row, dart, rank = _darts(element[rows], weight[rows].astype(float), (darts / total[todo])[own])
        slot = own[row] * size + (mix(dart + STEP) % np.uint64(size)).astype(np.int64)
        best = np.full(len(todo) * size, np.inf)
        np.minimum.at(best, slot, rank)
        win = rank == best[slot]
        earliest = np.zeros(len(todo) * size, np.uint64)
        earliest[slot[win]] = dart[win]
        full = np.isfinite(best).reshape(-1, size).all(axis=1)
        out[todo[full]] = earliest.reshape(-1, size)[full]
        todo, darts = todo[~full], 2 * darts
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.repeat((np.arange(1, bands + 1).astype(np.uint64) * STEP)[None, :], len(signature), axis=0)
    for r in range(rows):
        out = mix(out + parts[:, :, r])
    return out


# --- Spark jobs -------------------------------------------------------------------------------------

#: Members of a bucket that are compared with each other in one task, about.
PART = 256
#: Shingles that the members of a part have together, about (a longer text goes alone).
PART_SHINGLES = 4_000_000
#: Parts of a bucket that meet its later parts in a round.
LEAD_PARTS = 4
#: The bands of the first comparisons, which already join most groups.
FIRST_BANDS = 6


def _digests(of: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int) -> list[bytes | None]:
    """16 bytes for each bag, equal for equal bags; None for one without shingles."""
    size = np.bincount(of, weight, sets).astype(np.uint64)
    halves = []
    for salt in (M1, M2):
        total = np.zeros(sets, np.uint64)
        np.add.at(total, of, mix(mix(element ^ salt) + weight.astype(np.uint64)))
        halves.append(mix(total + size))
    return [d.tobytes() if n else None for d, n in zip(np.stack(halves, axis=1), size.tolist())]


def _content(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A bag as a sorted set of 32-bit values: the n-th occurrence of a shingle is a value of its own."""
    copies = np.repeat(element, weight) + _within(weight).astype(np.uint64) * STEP
    return np.sort((mix(copies) >> np.uint64(32)).astype(np.uint32))


def _sign(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    number = attempt()[0] << 33
    for batch, texts in text_batches(batches):
        of, element, weight = shingle_bags(texts, words)
        own = band_hashes(signatures(of, element, weight, len(texts), bands * rows), bands, rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(texts))), batch.column(0), batch.column(2),
                                          pa.array(_digests(of, element, weight, len(texts)), pa.binary()),
                                          pa.array(np.bincount(of, weight, len(texts)).astype(np.int64)), _lists(own)],
                                         names=["row", "doc_id", "text_hash", "bag", "size", "bands"])
        number += len(texts)


def _lists(bands: np.ndarray) -> pa.ListArray:
    n, width = bands.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(bands.ravel().view(np.int64)))


def _contents(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The bags of texts as sorted values, once per task and node (rows of one doc_id and text are one node)."""
    seen: set[int] = set()
    for batch, texts in text_batches(batches, 0):
        nodes = batch.column(1).to_pylist()
        new = [k for k, n in enumerate(nodes) if n not in seen and not seen.add(n)]
        of, element, weight = shingle_bags([texts[k] for k in new], words)
        start = np.searchsorted(of, np.arange(len(new) + 1))
        content = [_content(element[i:j], weight[i:j]).tobytes() for i, j in zip(start[:-1], start[1:])]
        kept = batch.take(pa.array(new, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(1), pa.array(content, pa.binary()), kept.column(2)], names=["node", "content", "bands"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Forest:
    """Sets of numbers joined by links; each is named by its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (above := up.get(x, x)) != x:
            up[x] = x = up.get(above, above)
        return x

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.root(a), self.root(b)))
        if low != high:
            self.up[high] = low

    def stars(self) -> Iterator[pa.RecordBatch]:
        """(a, b): every member but the smallest of each set, and that smallest."""
        if self.up:
            yield pa.RecordBatch.from_arrays([pa.array(list(self.up), pa.int64()), pa.array([self.root(x) for x in self.up], pa.int64())], names=["a", "b"])


def _near(bucket: int, mine: np.ndarray, my_bands: np.ndarray, theirs: np.ndarray, their_bands: np.ndarray, similar: float) -> bool:
    """Whether two texts are similar, asked in the first band that they share only."""
    small, large = sorted((len(theirs), len(mine)))
    if small < similar * large or their_bands[np.argmax(their_bands == my_bands)] != bucket:
        return False
    both = _shared(theirs, mine)
    return both >= similar * (small + large - both) - 1e-9


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    bands = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, -1)
    contents = (np.frombuffer(c, np.uint32) for c in batch.column("content").to_pylist())
    own = [batch.column(n).to_pylist() for n in batch.schema.names if n not in ("content", "bands")]
    return zip(*own, contents, bands)


def _link(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Links among the members of each part of a bucket; rows (bucket, part, comp, content, bands) come part by part.

    Members joined already, by any part of this task, are not compared.
    """
    group, members, forest = None, [], Forest()
    for batch in batches:
        for bucket, part, comp, content, bands in _rows_of(batch):
            if (bucket, part) != group:
                group, members = (bucket, part), []
            for other, theirs, their_bands in members:
                if forest.root(comp) != forest.root(other) and _near(bucket, content, bands, theirs, their_bands, similar):
                    forest.join(comp, other)
            members.append((comp, content, bands))
    yield from forest.stars()


def _compare(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Links between the members of each part and leaders from earlier ones; rows come part by part, leaders first."""
    group, leaders, forest = None, [], Forest()
    for batch in batches:
        for bucket, part, leads, comp, content, bands in _rows_of(batch):
            if (bucket, part) != group:
                group, leaders = (bucket, part), []
            if leads:
                leaders.append((comp, content, bands))
                continue
            for other, theirs, their_bands in leaders:
                if forest.root(comp) != forest.root(other) and _near(bucket, content, bands, theirs, their_bands, similar):
                    forest.join(comp, other)
    yield from forest.stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected with.

    Large-star and small-star steps in turn, until the edges form stars. Each step is a grouped minimum and
    a join; both are written together, so no task or driver holds a component.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        now = staging.written(small.union(least).filter("a != b").distinct(), "stars")
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("below")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("below")))
        uses = ends.groupBy("n").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
        # In stars a node is once below another one, or never.
        if uses.filter("below > 1 OR below > 0 AND least = 0").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _relabel(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    moved = rows.join(roots.select(F.col("node").alias(column), F.col("root").alias("moved")), column, "left")
    return moved.withColumn(column, F.coalesce("moved", column)).drop("moved")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest doc_id of their class of near-duplicates.

    Rows of one doc_id and text count once; a text without words is alone in its class, so all its rows are kept.
    """
    names = docs.columns
    rows = _classes(docs, **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.groupBy("node").agg(F.min_by(F.struct("doc_id", "text_hash", "words"), order).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"), "k.words").distinct()
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text()).alias("hash"), F.struct(*(docs[c] for c in names)).alias("own"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    each = F.when(F.col("words"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return packed.join(kept, same).withColumn("each", each).dropDuplicates(["id", "hash", "each"]).select("own.*")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id, a row per row of ``docs``; class_id is the smallest doc_id of the class (see _classes).

    A class of null ids only has a null class_id.
    """
    rows = _classes(docs, **options)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "node").select("doc_id", "class_id")


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets whose members are not all connected."""
    spread = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket")
    return members.join(spread, "bucket", "left_semi")


def _classes(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, text_hash, node and words (has any), a row per row of ``docs``: classes of texts linked by a similarity of ``similar`` or more.

    The similarity is the weighted Jaccard similarity of bags of ``words``-word shingles (lower case, split
    at white space; a text of fewer words is one shingle). A text that is null or has no words is alone in its
    class. Rows of one class have one ``node``.

    Equal bags are one node, named by its smallest row. Nodes that agree in a whole band of the signature share
    a bucket. A bucket is cut into parts of bounded size, fixed once. First the members of each part are compared
    with each other, exactly, in the first bands, then in the others where a bucket still has members that are not
    connected; that ends all buckets of one part. Of larger ones that are still open a few parts lead in each round:
    they meet all later parts and step out, until the members left are connected. In the end any two members of a
    bucket were compared or are connected; no class depends on the parts.
    """
    plain = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = staging.written(plain.mapInArrow(partial(_sign, words=words, bands=bands, rows=rows),
                                              "row long, doc_id long, text_hash long, bag binary, size long, bands array<long>"), "signed")
    known = signed.filter("bag IS NOT NULL")
    nodes = known.groupBy("bag").agg(F.first("bands").alias("bands"), F.first("size").alias("size"),
                                     F.min(F.struct("row", "doc_id", "text_hash")).alias("one"))
    exploded = nodes.select(F.col("one.row").alias("node"), "size", F.posexplode("bands").alias("band", "bucket"))
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / PART_SHINGLES)).cast("int")
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("members"), parts.alias("parts")).filter("members > 1")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = exploded.join(shared, "bucket").select("bucket", "band", "node", part.alias("part"), "parts")
    members = staging.written(members, "buckets")
    texts = nodes.select(F.col("one.row").alias("node"), F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("hash"), "bands")
    texts = texts.join(members.select("node"), "node", "left_semi")
    # A row of `plain` meets one text at most: equal ids with equal texts are one node.
    found = plain.join(texts, plain["doc_id"].eqNullSafe(texts["id"]) & (plain["text_hash"] == texts["hash"])).select("text", "node", "bands")
    contents = found.mapInArrow(partial(_contents, words=words), "node long, content binary, bands array<long>").dropDuplicates(["node"])
    contents = staging.written(contents, "contents")

    def meet(rows: DataFrame, *extra: str) -> DataFrame:
        return rows.join(contents, "node").select("bucket", "part", *extra, "comp", "content", "bands").repartition("bucket", "part")

    def within(rows: DataFrame) -> DataFrame:
        return staging.written(meet(rows).sortWithinPartitions("bucket", "part", "comp")
                               .mapInArrow(partial(_link, similar=similar), "a long, b long"), "links")

    own = members.withColumn("comp", F.col("node"))
    links = within(own.filter(F.col("band") < FIRST_BANDS))
    near = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    links = links.unionByName(within(_open(_relabel(own, near, "comp")).filter(F.col("band") >= FIRST_BANDS)))
    labels = None if links.isEmpty() else components(links)
    large = own.filter("parts > 1")
    if labels is not None and not large.isEmpty():
        large = _relabel(large, labels, "comp")
    for lead in count(0, LEAD_PARTS):
        # Parts before `lead` are done: they have met all others. A bucket with one part left is done too.
        large = staging.written(_open(large.filter((F.col("part") >= lead) & (F.col("parts") - lead > 1))), "open")
        if large.isEmpty():
            break
        later = F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1))
        leaders = large.filter((F.col("part") < lead + LEAD_PARTS) & (F.col("part") < F.col("parts") - 1))
        rows = (large.select("bucket", "part", "node", "comp", F.lit(False).alias("leads"))
                .unionByName(leaders.select("bucket", later.alias("part"), "node", "comp", F.lit(True).alias("leads"))))
        found = meet(rows, "leads").sortWithinPartitions("bucket", "part", F.desc("leads"))
        links = staging.written(found.mapInArrow(partial(_compare, similar=similar), "a long, b long"), "links")
        if not links.isEmpty():
            if labels is not None:
                links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
            labels = components(links)
            large = _relabel(large, labels, "comp")
    classes = known.select("row", "doc_id", "text_hash", "bag").join(nodes.select("bag", F.col("one.row").alias("node")), "bag").drop("bag")
    if labels is not None:
        classes = _relabel(classes, labels, "node")
    alone = signed.filter("bag IS NULL").select("row", "doc_id", "text_hash", F.col("row").alias("node"), F.lit(False).alias("words"))
    return staging.written(classes.select("row", "doc_id", "text_hash", "node", F.lit(True).alias("words")).unionByName(alone), "classes")
