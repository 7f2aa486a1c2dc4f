"""Words and hashes of many texts at once: NumPy over one UTF-8 buffer, inside Arrow batches.

Everything works on slices of at most ``CHUNK`` bytes (one text may be longer), so memory stays
bounded whatever the batch. Null texts are empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Texts:
    """Some rows of a batch and their bytes; text i is buf[bounds[i]:bounds[i + 1]]."""

    rows: pa.RecordBatch
    buf: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def raw(self, i: int) -> bytes:
        return self.buf[self.bounds[i] : self.bounds[i + 1]].tobytes()


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, chunk: int = CHUNK, rows: int = 1 << 20) -> Iterator[Texts]:
    """Consecutive rows, at most ``rows``, whose texts together have at most ``chunk`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.string()).fill_null("")
        bounds = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + chunk, "right")) - 1))
            yield Texts(batch.slice(lo, hi - lo), data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            lo = hi


@dataclass
class Words:
    """Word j is buf[start[j]:end[j]]; those of text i are first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text())


def split_words(t: Texts, spaces: np.ndarray = _SPACES) -> Words:
    """Runs of bytes that are no white space; a word ends with its text."""
    inside = ~spaces[t.buf]
    n = len(inside)
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = t.bounds[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on every bit of x."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), 0x9E3779B97F4A7C15, U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def constants(n: int) -> np.ndarray:
    """n fixed odd multipliers, one for each place of a sequence."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def word_hashes(t: Texts, w: Words, fold: np.ndarray | None = None, block: int = 100_000) -> np.ndarray:
    """A 64-bit hash of every word's bytes, after ``fold`` (a table of 256 bytes) if given."""
    out = np.empty(len(w), U64)
    for lo in range(0, len(w), block):
        start, end = w.start[lo : lo + block], w.end[lo : lo + block]
        size = end - start
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        data = t.buf[place + np.repeat(start, size)]
        if fold is not None:
            data = fold[data]
        value = (data.astype(U64) + U64(1)) * powers(int(size.max()))[place]
        out[lo : lo + block] = mix(np.add.reduceat(value, at) + size.astype(U64) * U64(0xA24BAED4963EE407))
    return out


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive entries of h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for i, factor in enumerate(constants(width)):
        total += h[i : i + n] * factor
    return mix(total)


def as_long(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed BIGINT."""
    return h.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per row from flat values and the rows' counts."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... of counts[i] entries each, one after the other."""
    at = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(at, counts) + np.repeat(first, counts)
