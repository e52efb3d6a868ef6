"""Hashes of words by whole arrays of bytes, and batches of texts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that a task works on at a time (a longer text goes alone).
CHARACTERS = 400_000

M1, M2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE, _UNBASE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def nth(k: int) -> np.uint64:
    return np.uint64(k * int(STEP) % (1 << 64))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHARACTERS)
            self.up, self.down = (np.cumprod(np.array([1] + [b] * size, np.uint64)) for b in (_BASE, _UNBASE))
        return self.up, self.down


_powers = Powers()


def word_hashes(texts: list[str], gaps: np.ndarray = SPACE, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has. Words are lower-cased runs of bytes that are no gaps.

    With ``prefix``, only so many first bytes of each word count.
    """
    data = [t.lower().encode() for t in texts]
    sizes = np.array([len(d) + 1 for d in data])
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    gap = gaps[raw]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(begin) and len(end) > len(begin):
        end = end[-len(begin):]
    stop = end if prefix is None else np.minimum(end, begin + prefix)
    up, down = _powers.get(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)])])
    words = mix((total[stop] - total[begin]) * down[begin])
    per_text = np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))
    return words, per_text


def text_batches(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows and their texts (null: empty), about CHARACTERS bytes at a time; only so many are Python strings at once."""
    for batch in batches:
        texts, start = batch.column(column), 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while start < len(texts):
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + CHARACTERS, "right")))
            yield batch.slice(start, end - start), [t or "" for t in texts.slice(start, end - start).to_pylist()]
            start = end
