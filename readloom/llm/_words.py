"""Vectorised words, word hashes and word n-grams over Arrow string columns.

Words: ASCII letters are lower-cased and words are maximal runs of ASCII letters, digits and
non-ASCII bytes, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Everything is computed on whole column chunks with numpy, never word by word in Python. A text
is always processed whole, so a task needs about 60 bytes of memory per byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.zeros(256, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 20
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 64, 2 * len(_powers))
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


@dataclass
class Words:
    """Words of a chunk of texts: byte spans in ``raw`` and the text each word belongs to."""

    raw: np.ndarray
    low: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first word of each text; one more entry at the end
    offset: np.ndarray  # byte offset of each text; one more entry at the end

    def hashes(self) -> np.ndarray:
        n = len(self.begin)
        if not n:
            return np.zeros(0, np.uint64)
        size = self.end - self.begin
        letters = self.low[self.low > 0].astype(np.uint64)
        at = np.zeros(n, np.int64)
        np.cumsum(size[:-1], out=at[1:])
        place = np.arange(len(letters)) - np.repeat(at, size)
        letters *= _power_table(int(size.max()))[place]
        return mix(np.add.reduceat(letters, at) + size.astype(np.uint64))

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside one text, and the word each starts at."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        value, factor = h[:n].copy(), np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(1, k):
                factor = factor * _STEP
                value += h[j : j + n] * factor
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(value[at] + np.uint64(k)), at

    def key(self, word: int, k: int) -> bytes:
        """The exact normalised form of ``k`` words."""
        return b" ".join(self.low[self.begin[i] : self.end[i]].tobytes() for i in range(word, word + k))


def words_of(texts: pa.Array) -> Words:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0 or texts.buffers()[2] is None:
        offset, raw = np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    else:
        offset = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offset[0] : offset[-1]]
        offset = offset - offset[0]
    low = _LOWER[raw]
    inside = low > 0
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = offset[(offset > 0) & (offset < len(raw))]
    start[edge] |= inside[edge]
    stop[edge - 1] |= inside[edge - 1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(begin, offset)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(raw, low, begin, end, doc, first, offset)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64) + 16
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to
