"""WARC archives: pages written as one gzip stream a file, then normalised to a member per record with an offset index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.llm.common import attempt, filesystem, slices, tasks, write_whole
from tapewise.sources import staging

DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that the normaliser inflates at a time.
READ = 1 << 20

FILES = "path string, n_records long, n_bytes long"
INDEX = "path string, offset long, length long, record_id string, record_type string, payload_digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    inner = name.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "none" else int(inner)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str = DATE) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the full payload's length, and drops the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, without the first line; folded lines are joined."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, inflated once from front to back, READ at a time at most.

    Raises if the file ends inside a member, its trailer (length and check sum) included.
    """
    plain, inside = zlib.decompressobj(31), False
    while data := source.read(READ):
        while data:
            yield plain.decompress(data, READ)
            data, inside = plain.unconsumed_tail, True
            if plain.eof:
                data, plain, inside = plain.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
    while inside and (rest := plain.decompress(b"", READ)):
        yield rest
    if inside and not plain.eof:
        raise EOFError("the gzip stream is cut off")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by their lengths; raises on a stream that ends inside one."""
    held = bytearray()

    def fill() -> None:
        block = next(blocks, None)
        if block is None:
            raise EOFError("the archive ends inside a record")
        held.extend(block)

    while True:
        while not held.strip(b"\r\n"):
            block = next(blocks, None)
            if block is None:
                return
            held.extend(block)
        while held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            fill()
        if not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        size = end + 4 + int(parse_headers(bytes(held[:end]))["content-length"])
        while len(held) < size:
            fill()
        yield bytes(held[:size]) + b"\r\n\r\n"
        del held[:size]


def _write(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> Iterator[pa.RecordBatch]:
    part, name = attempt()
    n = 0

    def write(stream) -> None:
        nonlocal n
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in slices(batches):
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                stream.write(packer.compress(record(page, url, payload, refers, base32_sha1(payload))))
                n += 1
        stream.write(packer.flush())

    path = f"{folder}/whole-{part:06d}.warc.gz"
    size = write_whole(path, name, write)
    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})


def with_roles(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, html (null: empty) and refers_to: the largest page_id with an equal payload of at least ``smallest`` bytes.

    It is null for that page itself (and for repeated rows of its page_id), for smaller payloads and where no
    page with the payload has an id. Payloads are equal if their SHA-1 is. The grouped maximum is combined
    before the shuffle; the join back to the pages of a hot payload can be split.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload", F.sha1(F.col("html").cast("binary")))
    largest = rows.filter(F.octet_length("html") >= smallest).groupBy("payload").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies")).filter("copies > 1")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return rows.join(largest, "payload", "left").select("page_id", "url", "html", other.alias("refers_to"))


def write_whole_files(roles: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Archives of one gzip stream per task, from rows of ``with_roles``; returns and keeps a list of them (path, n_records, n_bytes)."""
    roles.mapInArrow(partial(_write, folder=folder, level=level), FILES).write.parquet(f"{folder}/files")
    return roles.sparkSession.read.parquet(f"{folder}/files")


def _normalise(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> Iterator[pa.RecordBatch]:
    _, name = attempt()
    for batch in batches:
        for path in batch.column(0).to_pylist():
            base = path.rsplit("/", 1)[1].removesuffix(".warc.gz").replace("whole-", "records-")
            target, rows = f"{folder}/{base}.warc.gz", []

            def write(stream) -> None:
                fs, place = filesystem(path)
                with fs.open_input_stream(place, compression=None) as source:
                    for one in records(inflate(source)):
                        fields = parse_headers(one[:one.index(b"\r\n\r\n")])
                        member = gzip.compress(one, level, mtime=0)
                        rows.append((target, stream.tell(), len(member), fields["warc-record-id"], fields["warc-type"],
                                     fields.get("warc-payload-digest", "").removeprefix("sha1:")))
                        stream.write(member)

            write_whole(target, name, write)
            write_whole(f"{folder}/{base}.index.jsonl", name, lambda stream: stream.write("".join(
                json.dumps(dict(zip(("offset", "length", "record_id", "record_type", "payload_digest"), r[1:]))) + "\n" for r in rows).encode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "offset", "length", "record_id", "record_type", "payload_digest"])


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites archives so that every record is a gzip member of its own; returns the offset index of all records.

    Each file of ``files`` (path) is inflated once, by one task. Beside the new archive lies its index as JSON
    lines, and all of it as a table in ``folder``/index. Archives with several members are read as well; one that
    ends inside a record or a member raises. Files without records give an empty archive.
    """
    (files.select("path").repartition(tasks(files.sparkSession), "path")
     .mapInArrow(partial(_normalise, folder=folder, level=level), INDEX).write.parquet(f"{folder}/index"))
    return files.sparkSession.read.parquet(f"{folder}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, source = None, None
    for batch in batches:
        rows = []
        for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if path != opened:
                fs, place = filesystem(path)
                opened, source = path, fs.open_input_file(place)
            one = gzip.decompress(source.read_at(length, offset))
            head, _, block = one.partition(b"\r\n\r\n")
            fields = parse_headers(head)
            http, _, payload = block[:int(fields["content-length"])].partition(b"\r\n\r\n")
            digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            size = int(parse_headers(http)["content-length"])
            if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                raise ValueError(f"{path} at {offset}: the payload is not the one written")
            refers = fields.get("warc-refers-to")
            rows.append((page_of(fields["warc-record-id"]), size, digest, kind, refers and page_of(refers), payload if kind == "response" else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_records(index: DataFrame) -> DataFrame:
    """Every record of the index, read from its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a response is held against its digest; that of a revisit is null, its length and digest are
    those of the full payload.
    """
    rows = index.select("path", "offset", "length").repartition(tasks(index.sparkSession), "path").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to whole-file archives, to normalised ones, and back through their index; without the payloads.

    A row per row of ``pages``: null html is an empty payload, rows of a null or repeated page_id are records like others (see
    ``with_roles``), columns beyond page_id, url and html are left out, no pages give no rows.
    """
    folder = staging.new_path(spark, "warc")
    files = write_whole_files(with_roles(pages), f"{folder}/whole")
    return read_records(normalise(files, f"{folder}/records")).drop("payload")
