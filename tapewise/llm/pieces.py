"""SentencePiece encoding by a table of distinct chunks, and decoding.

Where the normaliser leaves texts as they are and no piece has a white-space marker behind another character, no
merge crosses the border in front of a run of markers. So a text's ids are those of its chunks - a run of markers
and the word behind it - one after the other. A task segments every distinct chunk of its rows once, many in one
call of the library, keeps the ids in a table of bounded size and joins them back by position.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import whole_text
from tapewise.llm.hashing import text_batches

MARKER = "▁"
#: A chunk of a text that begins with a space; a marker in a text counts as a space.
CHUNK = regex.compile(f"[ {MARKER}]+[^ {MARKER}]*")
#: Chunks that a worker keeps, twice this number at most: when the newer half is full, the older one goes.
KEPT_CHUNKS = 400_000
LONGEST_KEPT = 64


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Ids of texts, and texts of ids, of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any(a != MARKER and b == MARKER for p in pieces for a, b in zip(p, p[1:]))
        # Spaces become markers and one is put in front; nothing else may change, or chunks could not stand alone.
        probe = "  a  éé ａ①Å\n\t b "
        plain = self.model.normalize(probe) == (" " + probe).replace(" ", MARKER) and self.model.normalize("") == ""
        # The library puts no marker before an empty text, so the chunk of one marker alone has its own entry.
        self.marker = array("I", [self.model.piece_to_id(MARKER)]).tobytes()
        if crossing or not plain or self.model.is_unknown(self.model.piece_to_id(MARKER)):
            raise ValueError("pieces across white space, or a normaliser that changes texts, are not supported")
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks without the first marker of each, which the library puts before what it encodes."""
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts or MARKER in text:
            return [c[1:] for c in CHUNK.findall(" " + text)]
        return parts

    def _segment(self, chunks: Iterable[str]) -> dict[str, bytes]:
        chunks = list(chunks)
        return {c: array("I", ids).tobytes() for c, ids in zip(chunks, self.model.encode(chunks, num_threads=1, add_bos=False, add_eos=False, enable_sampling=False))}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows = [self.chunks(t) for t in texts]
        wanted = set().union(*rows)
        table = {c: ids for c in wanted if (ids := self.newer.get(c) or self.older.get(c)) is not None}
        table |= self._segment(wanted - table.keys() - {""}) | {"": self.marker}
        kept = {c: ids for c, ids in table.items() if 0 < len(c) <= LONGEST_KEPT and c not in self.newer}
        if len(self.newer) + len(kept) > KEPT_CHUNKS:
            self.older, self.newer = self.newer, {}
        self.newer |= kept if len(kept) <= KEPT_CHUNKS else {}
        return [b"".join(map(table.__getitem__, row)) for row in rows]

    def decode(self, ids: bytes) -> str:
        """The library's decode() of these ids."""
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    """One per worker process and model, kept from task to task."""
    return ChunkTable(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = chunk_table(path)
    for batch, texts in text_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table.encode(texts), pa.binary())], names=["doc_id", "ids"])


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text; null and empty texts have no ids.

    Rows with null or repeated doc_id are rows like others; further columns are left out; no rows give no rows.
    """
    return (docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .mapInArrow(partial(_encode, path=model or default_pieces()), "doc_id long, ids binary"))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = chunk_table(path)
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([one.column(0), pa.array([table.decode(one.column(1)[0].as_py())])], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the decoded text of rows of ``encode``; null ids give an empty text."""
    ids = F.coalesce(F.col("ids"), F.lit(b"").cast("binary")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(partial(_decode, path=model or default_pieces()), "doc_id long, text string")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = chunk_table(path)
    for batch, texts in text_batches(batches):
        rows = []
        for ids in table.encode(texts):
            listed = np.frombuffer(ids, "<u4").tolist()
            rows.append((len(listed), hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest(),
                         hashlib.sha256(table.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                         names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids (decimal, joined by commas) and of the text decoded from them.

    Null texts count as empty; rows with null or repeated doc_id are rows like others; further columns are left out.
    Both directions run in one task per batch, so neither ids nor decoded texts leave the worker.
    """
    return (docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .mapInArrow(partial(_round_trip, path=model or default_pieces()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
