import hashlib
import random

import numpy as np
import pytest

from tapewise.llm import pieces
from tapewise.llm.common import table
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_pieces())


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_digests_equal_the_library_on_the_given_table(spark, library):
    docs = table(spark, SMALL, "documents")
    got = {r[0]: tuple(r)[1:] for r in pieces.round_trip_digests(docs).collect()}
    assert got == {r["doc_id"]: expected(library, r["text"]) for r in docs.select("doc_id", "text").collect()}


def test_random_texts_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 40)  # the table is full again and again
    rng, own = random.Random(2), pieces.ChunkTable(pieces.default_pieces())
    letters = [" ", " ", "  ", "▁", "\n", "\t", "a", "b", "the", "é", "Ａ", "🙂", "é", "\x00", "　", "\xa0", "<s>", "</s>", "<0x0A>", "<unk>", "ß", "0", "x" * 80]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for k in range(0, len(texts), 50):
        part = texts[k:k + 50]
        ids = own.encode(part)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode(t) for t in part]
        assert [own.decode(i) for i in ids] == [library.decode(library.encode(t)) for t in part]
    assert len(own.newer) <= 40 and len(own.older) <= 40


def test_a_chunk_is_segmented_once_in_a_batch(monkeypatch):
    own, asked = pieces.ChunkTable(pieces.default_pieces()), []
    plain = own._segment
    monkeypatch.setattr(own, "_segment", lambda chunks: asked.extend(chunks) or plain(asked))
    own.encode(["one two one", "two one  two", "", "three"])
    assert sorted(asked) == sorted(["one", "two", " two", "three"])


def test_encode_and_decode_as_tables(spark, library, odd_docs):
    encoded = pieces.encode(odd_docs)
    texts = {(r["doc_id"], r["text"]) for r in pieces.decode(encoded).collect()}
    assert texts == {(r["doc_id"], library.decode(library.encode(r["text"] or ""))) for r in odd_docs.select("doc_id", "text").collect()}
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["text"] == ""


def test_odd_rows(odd_docs, odd_rows, no_docs, library):
    got = sorted((tuple(r) for r in pieces.round_trip_digests(odd_docs).collect()), key=repr)
    assert got == sorted(((i, *expected(library, t)) for i, t in odd_rows), key=repr)
    assert pieces.round_trip_digests(no_docs).count() == 0
