"""Packing by harmonic classes: a class holds the lengths between capacity/(j+1) and capacity/j, j of which fill a sequence."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewise.llm.common import attempt, probe_names, slices, whole_text
from tapewise.llm.tokens import default_tokenizer, text_ids
from tapewise.sources import staging

CAPACITY = 4096
END_ID = 2
#: A sequence of whole class mates may stay empty by this share of the capacity; else a length is cut.
SPARE = 128

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("class", pa.int32()), ("worker", pa.int32()), ("rank", pa.int64())])


def cut_lengths(n: int, capacity: int = CAPACITY, spare: int = SPARE) -> list[int]:
    """Lengths of the pieces of ``n`` ids, each at most ``capacity``.

    After whole sequences, the rest r belongs to class j = capacity // r. If j pieces like it leave at most
    capacity / spare of a sequence empty it stays whole. Otherwise the longest length of the next class,
    capacity // (j + 1), is cut off, which fills its sequences, and the rule applies to what remains.
    """
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        piece = rest if (capacity - j * rest) * spare <= capacity else capacity // (j + 1)
        lengths.append(piece)
        rest -= piece
    return lengths


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, spare: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, (worker, _) = text_ids(path), attempt()
    filled: Counter[int] = Counter()
    end = END_ID.to_bytes(4, "little")
    for batch in slices(batches):
        rows, blobs = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = encoder.encode(text) + end
            n, start = len(ids) // 4, 0
            for length in cut_lengths(n, capacity, spare):
                part = ids[4 * start:4 * (start + length)]
                j = capacity // length
                rows.append((doc_id, start, length, zlib.crc32(part), n, j, worker, filled[j]))
                filled[j] += 1
                start += length
                if with_ids:
                    blobs.append(part)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)]
        if with_ids:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], schema=PIECES.append(pa.field("ids", pa.binary())))
        else:
            yield pa.RecordBatch.from_arrays(columns, schema=PIECES)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, spare: int = SPARE,
           with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with its class and its rank among the pieces of that class on its worker.

    A document is the ids of its whole text (null: empty) and an end id, so every row has at least one
    piece. Documents with a null or repeated doc_id are documents like others. ``with_ids`` adds the ids,
    as little-endian unsigned 32-bit integers. Ranks hold within one run of a task: write the rows before use.
    """
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker int, rank long"
    return (probe_names(docs, F.col("doc_id").cast("long"), whole_text())
            .mapInArrow(partial(_pieces, path=tokenizer or default_tokenizer(), capacity=capacity, spare=spare, with_ids=with_ids),
                        kinds + ", ids binary" * with_ids))


def _last_sequences(frames: Iterator[pd.DataFrame], capacity: int, first: int) -> Iterator[pd.DataFrame]:
    """First-fit decreasing over what no full set of class mates was left for; fewer than j pieces of each class."""
    rows = pd.concat([*frames], ignore_index=True)
    rows = rows.sort_values(["length", "doc_id", "start", "worker", "rank"], ascending=[False, True, True, True, True], kind="stable")
    room: list[int] = []
    start_at: dict[int, int] = {}  # no bin before this one has room for the length
    chosen, offsets = [], []
    for length in rows["length"].tolist():
        b = start_at.get(length, 0)
        while b < len(room) and room[b] < length:
            b += 1
        if b == len(room):
            room.append(capacity)
        start_at[length] = b
        chosen.append(first + b)
        offsets.append(capacity - room[b])
        room[b] -= length
    yield rows.assign(sequence_id=chosen, offset=offsets).drop(columns=["at"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (written, see above) with sequence_id and offset; j class mates share a sequence.

    Each worker's pieces of a class follow those of the workers before it, so ranks in a class come from
    a table of counts per worker and class, and no task ever holds a class. Fewer than j pieces of each
    class are left over, at most the sum of j - 1 over at most ``capacity`` classes whatever the input:
    one small task packs them. Sequences are numbered without gaps. No rows give no rows.
    """
    extra = [c for c in pieces.columns if c not in PIECES.names]
    counts = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row per class
    base, full = {}, 0
    for j in sorted(totals):
        base[j] = full
        full += totals[j] // j
    before = counts.select("class", "worker", (F.sum("n").over(Window.partitionBy("class").orderBy("worker")) - F.col("n")).alias("earlier"))
    per_class = pieces.sparkSession.createDataFrame([(j, base[j], totals[j] // j * j) for j in totals], "class int, base long, whole long")
    ranked = (pieces.join(before, ["class", "worker"]).join(F.broadcast(per_class), "class")  # at most `capacity` rows
              .withColumn("at", F.col("rank") + F.col("earlier")))
    placed = ranked.filter(F.col("at") < F.col("whole")).withColumn("sequence_id", F.col("base") + F.floor(F.col("at") / F.col("class")))
    within = Window.partitionBy("sequence_id").orderBy("at")
    placed = placed.withColumn("offset", F.sum("length").over(within) - F.col("length"))
    names = [*PIECES.names, *extra]
    rest = ranked.filter(F.col("at") >= F.col("whole")).select(*names, "at").repartition(1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    rest = rest.mapInPandas(partial(_last_sequences, capacity=capacity, first=full), f"{kinds}, sequence_id long, offset long")
    return placed.select(*names, "sequence_id", "offset").unionByName(rest).drop("class", "worker", "rank")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut, number and pack: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(staging.written(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids, padded to ``capacity`` unless n_tokens is a power of two.

    ``packed`` has the ids of its pieces. A group is a sequence, so at most ``capacity`` pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    pad = F.when(F.expr("bit_count(n_tokens)") == 1, F.lit(0)).otherwise(F.lit(capacity) - F.col("n_tokens")).cast("int")
    body = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all, x: F.concat(all, x["ids"]))
    return joined.select("sequence_id", "n_tokens", F.concat(body, F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', {capacity}))").substr(F.lit(1), 4 * pad)).alias("ids"))
