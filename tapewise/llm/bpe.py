"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.common import slices, whole_text
from tapewise.llm.tokens import SEPARATORS, ChunkCache, byte_letters, default_tokenizer

#: Stands for the end of a word; no byte-level letter.
END = "\ue000"
NEVER = 1 << 60
#: Compatible and incompatible pairs that a worker keeps at most.
KEPT_PAIRS = 1_000_000


class Backtracker:
    """Exact merges of one word in linear time.

    A sequence of tokens is what the merges give if and only if each pair of neighbours is: none of the
    merges across the border comes first. ``compatible`` answers that from the tokens' derivations. Longest
    matches of an Aho-Corasick automaton are taken from the left; where a token cannot follow, shorter ones
    are tried, and then the token before is given up. A position given up once is never tried again.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        import ahocorasick

        self.suffix = suffix or ""
        own = self._own
        self.ids = {own(t): i for t, i in vocab.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        made = [(self.ids[own(a)], self.ids[own(b)], self.ids[own(a + b)]) for a, b in merges]
        for rank, (left, right, _) in enumerate(made):
            self.pair_rank.setdefault((left, right), rank)
        known = {i for t, i in self.ids.items() if len(t.removesuffix(END)) == 1}
        for rank, (left, right, whole) in enumerate(made):
            # Merging the letters of a token must end in it, by way of these two parts; others never come up.
            if whole not in known and left in known and right in known and self._crossing(left, right) == (left, right):
                self.parts[whole] = (left, right, rank)
                known.add(whole)
        reachable = {t: i for t, i in self.ids.items() if i in known}
        self.automaton = ahocorasick.Automaton()
        for t, i in reachable.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.length = {i: len(t) for t, i in reachable.items()}
        self.shorter: dict[int, int] = {}
        for t, i in reachable.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in reachable:
                    self.shorter[i] = reachable[t[:n]]
                    break

    def _own(self, token: str) -> str:
        return token[:-len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) and token != self.suffix else token

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at one border of a token, smallest first, each with the rank of the merge that takes it in."""
        spine = self.spines.get((token, side))
        if spine is None:
            spine, part, taken = [], token, NEVER
            while part in self.parts:
                spine.append((part, taken))
                *sides, taken = self.parts[part]
                part = sides[side]
            spine.append((part, taken))
            spine.reverse()
            self.spines[token, side] = spine
        return spine

    def _crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The parts that the first merge across the border of two neighbouring tokens joins, if there is one.

        The parts at the border grow as merges come in the order of their ranks. If the parts that face each
        other have a merge that comes before those that take either in, it crosses the border; of two merges
        of one rank the one further left comes first.
        """
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (x, taken_x), (y, taken_y) = a[i], b[j]
            rank = self.pair_rank.get((x, y), NEVER)
            if rank < taken_x and rank <= taken_y and rank < NEVER:
                return x, y
            if taken_x == taken_y == NEVER:
                return None
            if taken_x <= taken_y:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two neighbouring tokens alone."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._crossing(left, right) is None
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of a word in byte-level letters."""
        if self.suffix:
            word += END
        longest: list[int] = [-1] * len(word)
        for end, (n, token) in self.automaton.iter(word):
            longest[end - n + 1] = token  # matches of one start come with growing ends
        tokens: list[int] = []
        given_up = bytearray(len(word) + 1)
        at, token = 0, longest[0]
        while True:
            while token >= 0 and (given_up[at + self.length[token]] or tokens and not self.compatible(tokens[-1], token)):
                token = self.shorter.get(token, -1)
            if token >= 0:
                tokens.append(token)
                at += self.length[token]
                if at == len(word):
                    return tokens
                token = longest[at]
            else:
                if not tokens:
                    raise ValueError("the vocabulary has no letter for a byte of this word")
                given_up[at] = 1
                last = tokens.pop()
                at -= self.length[last]
                token = self.shorter.get(last, -1)


class BacktrackingBpe(ChunkCache):
    """encode() and decode() of a tokenizer file whose words are split at white space, which is dropped."""

    def __init__(self, path: str):
        import regex

        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]], [s["type"] for s in steps]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"]:
            raise ValueError("only tokenizers that drop white space and have no decoder are supported")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.words = Backtracker(model["vocab"], pairs, model["end_of_word_suffix"])
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) or "(?!)")
        names = {i: t for t, i in (model["vocab"] | self.added).items()}
        # The offset table: the UTF-8 of every token and a space, one after the other, and where each begins.
        spelt = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.ends = np.cumsum([0, *map(len, spelt)])

    def _plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        ids: list[int] = []
        for word in self.split.findall(low):
            ids += self.words.encode(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters))
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids, at = [], 0
        for m in self.special.finditer(chunk) if "<" in chunk else ():
            ids += self._plain(chunk[at:m.start()]) + [self.added[m[0]]]
            at = m.end()
        return array("I", ids + self._plain(chunk[at:])).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.split())) if not SEPARATORS.search(text) else self._chunk(text)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens of ``ids`` with a space between them; ids beyond the vocabulary have none."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        tokens = tokens[tokens < len(self.ends) - 1]
        start, size = self.ends[tokens], self.ends[tokens + 1] - self.ends[tokens]
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.spelt[place].tobytes()[:-1]


@lru_cache(maxsize=2)
def backtracking_bpe(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = backtracking_bpe(path)
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text; null texts count as empty."""
    return (docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .mapInArrow(partial(_encode, path=tokenizer or default_tokenizer()), "doc_id long, ids binary"))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = backtracking_bpe(path)
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(i) for i in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the decoded text of rows of ``encode``; null ids give an empty text."""
    ids = F.coalesce(F.col("ids"), F.lit(b"").cast("binary")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(partial(_decode, path=tokenizer or default_tokenizer()), "doc_id long, text string")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = backtracking_bpe(path)
    for batch in slices(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        n, a, b = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                         names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids and of the text decoded from them.

    Null texts count as empty; rows with null or repeated doc_id are rows like others. Both directions run in
    one task per batch, so neither ids nor decoded texts leave the worker.
    """
    return (docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .mapInArrow(partial(_round_trip, path=tokenizer or default_tokenizer()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
