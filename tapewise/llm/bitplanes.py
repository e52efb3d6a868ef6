"""Token files of bit or byte planes: blocks of ids, transposed, each plane compressed on its own, with a chunk index."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm.common import attempt, filesystem, slices, tasks, whole_text, write_whole
from tapewise.llm.tokens import default_tokenizer, text_ids
from tapewise.sources import staging

MAGIC = b"IDPLANE1"
BLOCK_IDS = 65536
END_ID = 1
LEVEL = 3
TAIL = struct.Struct("<QQQQB7x8s")  # where the index starts, its chunks, documents, ids, bits?, magic


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of little-endian unsigned 32-bit ids, least significant byte first."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(by_byte[:, k]).tobytes() for k in range(4)]
    one = np.unpackbits(by_byte, axis=1, bitorder="little")
    return [np.packbits(one[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    one = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(one, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes MAGIC, chunks of planes, the index and a tail of fixed size.

    A chunk holds ``block`` ids (the last one the rest). The index has, per chunk, its offset, number of ids
    and plane sizes, and per document its id (null as the smallest long and a flag) and number of ids.
    """

    def __init__(self, stream, block: int, bits: bool, level: int):
        self.stream, self.block, self.bits = stream, block, bits
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.at, self.n_ids, self.pending, self.pending_ids = len(MAGIC), 0, [], 0
        self.chunks: list[tuple[int, ...]] = []
        self.docs: list[tuple[int, int, int]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id is None, doc_id or 0, n))
        self.n_ids += n
        self.pending.append(ids)
        self.pending_ids += n
        if self.pending_ids >= self.block:
            self._flush(self.pending_ids // self.block)

    def _flush(self, blocks: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        for k in range(blocks):
            self._chunk(ids[k * self.block:(k + 1) * self.block])
        rest = ids[blocks * self.block:]
        self.pending, self.pending_ids = [rest.tobytes()], len(rest)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), *map(len, planes)))
        for p in planes:
            self.stream.write(p)
            self.at += len(p)

    def close(self) -> None:
        self._flush(self.pending_ids // self.block)
        if self.pending_ids:
            self._chunk(np.frombuffer(self.pending[0], "<u4"))
        index = np.array(self.chunks, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes()
        self.stream.write(self.compress(index))
        self.stream.write(TAIL.pack(self.at, len(self.chunks), len(self.docs), self.n_ids, self.bits, MAGIC))


class PlaneReader:
    """Reads such a file: its index at once, chunks one by one (or one by number)."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - TAIL.size)
        start, n_chunks, n_docs, self.n_ids, bits, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        self.bits, width = bool(bits), 2 + (32 if bits else 4)
        source.seek(start)
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(size - TAIL.size - start)), "<i8")
        self.chunks = index[:n_chunks * width].reshape(n_chunks, width)
        self.docs = index[n_chunks * width:].reshape(n_docs, 3)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.chunks[k])
        self.source.seek(at)
        data, plain = io.BytesIO(self.source.read(sum(sizes))), zstandard.ZstdDecompressor()
        return from_planes([plain.decompress(data.read(s)) for s in sizes], n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, ids before it in this file, and its ids, while holding one chunk and one document."""
        held, k, start = b"", 0, 0
        for null, doc_id, n in self.docs.tolist():
            parts, have = [held], len(held)
            while have < 4 * n:
                parts.append(self.chunk(k).tobytes())
                have += len(parts[-1])
                k += 1
            held = b"".join(parts) if len(parts) > 1 else held
            yield None if null else doc_id, start, held[:4 * n]
            held, start = held[4 * n:], start + n


MANIFEST = pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
READ_BACK = pa.schema([("file_no", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, block: int, bits: bool, level: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, (part, name), end = text_ids(path), attempt(), end_id.to_bytes(4, "little")
    told = {}

    def write(stream) -> None:
        planes = PlaneWriter(stream, block, bits, level)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                planes.add(doc_id, encoder.encode(text) + end)
        planes.close()
        told.update(n_docs=len(planes.docs), n_ids=planes.n_ids)

    file = f"{folder}/part-{part:06d}.idplanes"
    size = write_whole(file, name, write)
    yield pa.RecordBatch.from_pylist([{"file_no": part, "path": file, "n_bytes": size, **told}], MANIFEST)


def write_planes(docs: DataFrame, folder: str, tokenizer: str | None = None, block: int = BLOCK_IDS, bits: bool = False,
                 level: int = LEVEL, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents, in ascending doc_id order, to plane files in ``folder``; returns the manifest.

    A text is encoded whole (null: empty) and ends with ``end_id``. Files follow ranges of doc_id (null
    first); rows of one doc_id may spread over files and are ordered by their text's hash. The manifest has
    a row per file (file_no, path, n_docs, n_ids, n_bytes) and lies in ``folder``/manifest. An empty
    table gives no documents.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    rows = (docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .repartitionByRange(tasks(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie))
    told = rows.mapInArrow(partial(_write, folder=folder, path=tokenizer or default_tokenizer(), block=block, bits=bits, level=level, end_id=end_id),
                           "file_no int, path string, n_docs long, n_ids long, n_bytes long")
    told.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for told in batch.to_pylist():
            fs, path = filesystem(told["path"])
            rows = []
            with fs.open_input_file(path) as source:
                for doc_id, start, ids in PlaneReader(source).documents():
                    rows.append((told["file_no"], doc_id, start, len(ids) // 4, zlib.crc32(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ_BACK)], schema=READ_BACK)


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    held = manifest.filter("n_docs > 0")
    before = held.select("file_no", (F.sum("n_ids").over(Window.orderBy("file_no")) - F.col("n_ids")).alias("before"))  # a row per file
    read = (held.select("file_no", "path").repartition(tasks(manifest.sparkSession), "file_no")
            .mapInArrow(_read, "file_no int, doc_id long, local_start long, n_tokens long, ids_crc32 long"))
    return read.join(before, "file_no").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def planes_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Writes the plane files of ``docs`` and reads them back: doc_id, start, n_tokens and ids_crc32, a row per row of ``docs``.

    Null texts are empty and have their end id only; null ids come first, rows of one id in order of their text's hash;
    further columns are left out; no rows give no rows.
    """
    return read_digests(write_planes(docs, staging.new_path(spark, "planes"), tokenizer, **options))
