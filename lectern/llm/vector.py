"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of digits, letters and non-ASCII characters, with A-Z
lowered. Each gets a 64-bit hash, eight bytes at a step, so the cost is a few
array operations a word and no Python object is made for one.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_FOLD = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)

#: Drops what an operator keeps in a Python worker between its tasks; called when the worker turns to another one.
kept: list[Callable[[], None]] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _K1
    h ^= h >> _S32
    h *= _K2
    h ^= h >> _S29
    return h


@dataclass
class Words:
    #: one hash a word, texts one after another
    hashes: np.ndarray
    #: text i has the words bounds[i] to bounds[i + 1]
    bounds: np.ndarray
    #: byte spans of the words in the joined texts
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes of a string column and the offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pa.array(column, pa.large_string()) if not isinstance(column, pa.Array) else column.cast(pa.large_string())
    a = a.fill_null("") if a.null_count else a
    n, at = len(a), a.offset
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 21, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of text and ``rows`` rows at most, one row at least: bounds the arrays made of a part."""
    if kept:
        while kept:
            kept.pop()()
        gc.collect()
    for batch in batches:
        _, off = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
            yield batch.slice(at, end - at)
            at = end


def words(column) -> Words:
    raw, off = text_bytes(column)
    folded = np.zeros(len(raw) + 8, np.uint8)
    np.take(_FOLD, raw, out=folded[: len(raw)])
    inside = np.zeros(len(raw) + 2, bool)
    np.not_equal(folded[: len(raw)], 0, out=inside[1:-1])
    edge = off[(off > 0) & (off < len(raw))]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    # a text's first byte starts a word, and the last byte of the text before it ends one
    begin[edge] = inside[1:-1][edge]
    end[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(_hash(folded, starts, ends - starts), np.searchsorted(starts, off), starts, ends)


def _hash(folded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    lanes = np.ndarray(max(len(folded) - 7, 0), "<u8", folded, strides=(1,))
    h = sizes.astype(np.uint64)
    if len(starts):
        h = mix(h ^ (lanes[starts] & _MASK[np.minimum(sizes, 8)]))
    live, k = np.flatnonzero(sizes > 8), 8
    while len(live):
        part = lanes[starts[live] + k] & _MASK[np.minimum(sizes[live] - k, 8)]
        h[live] = mix(h[live] ^ part)
        k += 8
        live = live[sizes[live] > k]
    return h


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and each text's bounds among them.

    A text of fewer words, but not none, has one run of all its words.
    """
    counts = w.counts
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate(([0], np.cumsum(size)))
    first = np.repeat(w.bounds[:-1] - bounds[:-1], size) + np.arange(bounds[-1])
    length = np.minimum(np.repeat(counts, size), n)
    h = length.astype(np.uint64)
    for k in range(n):
        if k == 0 or counts.min(initial=n) >= n:
            h = mix(h ^ w.hashes[first + k])
        else:
            ok = length > k
            h[ok] = mix(h[ok] ^ w.hashes[first[ok] + k])
    return h, bounds
