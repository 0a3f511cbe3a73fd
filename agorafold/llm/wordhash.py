"""Vectorised words and word windows of a batch of texts.

A text's words are the maximal runs of bytes outside the ASCII white space
0x20, 0x09-0x0D, which is the same on code points and on UTF-8 bytes.  All
texts of a slice are handled by numpy passes over their bytes; there is no loop
over documents or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes whose numbers are held at once: some 30 bytes of memory each, whatever the length of a text.
CHUNK = 1 << 20
_U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Another rule: runs of ASCII letters and digits and of non-ASCII characters.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = {0: _stream(11, 256), 1: _stream(77, 256)}
_BASE = {0: 0x9FB21C651E98DF25, 1: 0xD6E8FEB86659FD93}
_POWERS = {k: _powers(b, 256) for k, b in _BASE.items()}


def _some(data: np.ndarray, start: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """Of each span the sum of its bytes' numbers, each times a power of its place."""
    longest = int(size.max())
    if longest > len(_POWERS[which]):
        _POWERS[which] = _powers(_BASE[which], min(CHUNK, 2 * longest))
    begin = np.zeros(len(start), np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    inside = np.arange(int(begin[-1] + size[-1]), dtype=np.int64) - np.repeat(begin, size)
    values = _BYTES[which][data[inside + np.repeat(start, size)]]
    values *= _POWERS[which][inside]
    return np.add.reduceat(values, begin)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64 bits of each span's bytes; no span is empty.

    About ``CHUNK`` bytes are worked on at a time; a longer span is summed in pieces.
    """
    n = len(start)
    out = np.zeros(n, _U)
    if not n:
        return out
    size = end - start
    upto = np.cumsum(size)
    low = 0
    while low < n:
        if size[low] > CHUNK:
            step, factor = _U(pow(_BASE[which], CHUNK, 1 << 64)), _U(1)
            with np.errstate(over="ignore"):
                for at in range(int(start[low]), int(end[low]), CHUNK):
                    piece = min(CHUNK, int(end[low]) - at)
                    out[low] += factor * _some(data, np.array([at]), np.array([piece]), which)[0]
                    factor = factor * step
            low += 1
            continue
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - size[low] + CHUNK, "right")))
        out[low:high] = _some(data, start[low:high], size[low:high], which)
        low = high
    return mix(out + size.astype(_U) * _U(0xA0761D6478BD642F))


@dataclass
class Words:
    """doc: text of each word; start, end: its bytes; first: index of each text's first word, and the end."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """64 bits of each word's bytes; ``which`` picks one of two independent functions."""
        return span_hashes(self.data, self.start, self.end, which)

    def windows(self, h: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, 64 bits) of each run of k words of one text."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        total = np.zeros(n, _U)
        for j, m in enumerate(_stream(1000 + which, k)):
            total += h[j : n + j] * m
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(total[at])


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False, rule: np.ndarray = _WORD) -> Words:
    """The words of all texts of an array of strings; null has none."""
    data, offsets = _raw(texts)
    if lower:
        data = LOWER[data]
    inside = rule[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    edge = inside.copy()
    if len(data):
        edge[1:] &= ~inside[:-1] | cut[1:-1]
    start = np.flatnonzero(edge)
    edge = inside.copy()
    if len(data):
        edge[:-1] &= ~inside[1:] | cut[1:-1]
    end = np.flatnonzero(edge) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, doc, start, end, np.searchsorted(doc, np.arange(len(texts) + 1), "left"))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(flags, offsets[filled], dtype=np.int64)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts have about ``size`` bytes, or are one text."""
    for batch in batches:
        _, offsets = _raw(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
