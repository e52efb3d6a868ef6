"""Token ids of whole texts, as the tokenizers library gives them."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Chunks that a worker keeps, twice this number at most: when the newer half is full, the older one goes.
KEPT_CHUNKS = 450_000
LONGEST_KEPT = 64
#: White space for Python's split() but not for a tokenizer's \s.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: A Latin word with punctuation behind it, which the splitting of word vocabularies parts.
MARKED = re.compile("([^\\W\\d_]+)([!-&(-/:-@\\[-`{-~]+)")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkCache(dict):
    """Ids of chunks between white space, kept in two halves of bounded size; ``_chunk`` makes those not kept."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._chunk(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= KEPT_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        raise NotImplementedError


class TextIds(ChunkCache):
    """Ids of a text as little-endian unsigned 32-bit integers.

    Where the tokenizer drops white space between its words, the ids of a text are those of its chunks
    between white space, one after the other. A chunk goes through the library once; the result is kept
    in this dictionary. Other tokenizers, and texts with separators that are white space for Python only,
    get the library's encode() over the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        steps = spec["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        self.by_chunk = any(s.get("type") == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps)
        if self.by_chunk:
            # The same model without its own cache, which would cost more than it saves for chunks seen once.
            m = spec["model"]
            pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
            self.model = models.BPE(vocab=m["vocab"], merges=pairs, cache_capacity=0,
                                    end_of_word_suffix=m["end_of_word_suffix"])
            self.letters = dict(enumerate(byte_letters()))

    def _chunk(self, chunk: str) -> bytes:
        # A Latin word needs no normaliser and no splitting; punctuation behind one is a chunk of its own.
        if chunk.isalpha():
            if max(chunk) < "ɐ":
                low = chunk.lower()
                if low != chunk and low.isalpha():
                    return self[low]
                if low == chunk:
                    if not low.isascii():
                        low = low.encode().decode("latin-1").translate(self.letters)
                    return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
        elif (m := MARKED.fullmatch(chunk)) and max(m[1]) < "ɐ" and m[1].lower().isalpha():
            return self[m[1]] + self[m[2]]
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.by_chunk and not SEPARATORS.search(text):
            return b"".join(map(self.__getitem__, text.split()))
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One per worker process and tokenizer, kept from task to task."""
    return TextIds(path)
