import base64
import gzip
import hashlib
import json
import zlib

import pytest

from tapewise.llm import common, warc
from tapewise.llm.common import table
from tests.conftest import SMALL


def expected(rows, smallest=0):
    groups = {}
    for page, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        known = [p for p in groups[html or ""] if p is not None]
        other = max(known) if known and max(known) != page and len(data) >= smallest else None
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


ODD = [(1, "u", "a"), (2, None, "a"), (3, "http://x/\r\nWARC-Type: fake é", "a"), (4, "u", None), (5, "u", ""), (None, "u", "b"), (None, "u", "b"), (6, "u", "b"),
       (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (8, "u", "\r\n\r\n\r\n"), (9, "u", "xé" * 400_000), (None, "u", "alone")]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ODD], "page_id long, url string, html string, refers_to string, payload int").repartition(3)
    got = sorted(map(tuple, warc.warc_round_trip(spark, pages).collect()), key=str)
    assert got == expected([(p, h) for p, _, h in ODD])


def test_the_given_pages_and_no_pages(spark):
    pages = table(spark, SMALL, "pages")
    copies = pages.selectExpr("page_id + 100000 AS page_id", "url", "html").filter("page_id % 3 = 0")
    both = pages.select("page_id", "url", "html").unionByName(copies)
    got = sorted(map(tuple, warc.warc_round_trip(spark, both).collect()), key=str)
    assert got == expected([(r["page_id"], r["html"]) for r in both.collect()])
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "aa"), (4, "u", "aa")], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in warc.with_roles(pages, 2).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_members_and_index_beside_the_archive(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "text %d" % (k // 2)) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_whole_files(warc.with_roles(pages).coalesce(1), str(tmp_path / "whole"))
    index = warc.normalise(files, str(tmp_path / "records"))
    assert index.count() == 20
    archive = sorted((tmp_path / "records").glob("*.warc.gz"))[0]
    lines = [json.loads(x) for x in archive.with_name(archive.name.replace(".warc.gz", ".index.jsonl")).read_text().splitlines()]
    data = archive.read_bytes()
    for line in lines:
        one = gzip.decompress(data[line["offset"]:line["offset"] + line["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and line["record_id"].encode() in one
    assert sum(x["length"] for x in lines) == len(data)


def test_streams_cut_off_raise_and_members_join():
    one = warc.record(1, "u", b"payload", None, warc.base32_sha1(b"payload"))
    class Source:
        def __init__(self, data): self.data = data
        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out
    two = gzip.compress(one) + gzip.compress(one)
    assert len(list(warc.records(warc.inflate(Source(two))))) == 2
    member = gzip.compress(one)
    for cut in (len(two) - 1, len(two) - 8, len(two) - 30, len(member) + 1, len(member) - 4):  # trailer, data, header, and the first member's trailer
        with pytest.raises(EOFError):
            list(warc.records(warc.inflate(Source(two[:cut]))))
    whole = gzip.compress(one * 3)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = packer.compress(one * 2) + packer.flush(zlib.Z_FULL_FLUSH)  # as if cut at the edge of a record
    assert len(list(warc.records(warc.inflate(Source(whole))))) == 3
    with pytest.raises(EOFError):
        list(warc.records(warc.inflate(Source(flushed))))
    with pytest.raises(EOFError):
        list(warc.records(iter([one[:-20]])))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"nonsense\r\n\r\n"])))


def test_a_bomb_is_inflated_in_pieces():
    class Source:
        def __init__(self, data): self.data = data
        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out
    sizes = [len(b) for b in warc.inflate(Source(gzip.compress(bytes(40 << 20)) + gzip.compress(b"end")))]
    assert sum(sizes) == (40 << 20) + 3 and max(sizes) <= warc.READ


def test_a_task_that_runs_again_replaces_its_file(tmp_path):
    for text in (b"first", b"again"):
        assert common.write_whole(f"file://{tmp_path}/part.bin", text.decode(), lambda stream: stream.write(text)) == 5
    assert [p.name for p in tmp_path.iterdir()] == ["part.bin"] and (tmp_path / "part.bin").read_bytes() == b"again"
