"""Vectorised text kernels over Arrow string columns (numpy, no Spark).

A text column is handled as one byte array with document offsets; words, hashes and n-grams are found for all documents of
a piece at once. Pieces are bounded in bytes, but a document is never split: a single long document is a piece of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters that are neither letters nor digits; bytes from 0x80 on belong to words.
PUNCT = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = 1 << n.bit_length()
            grow = lambda b: np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, b, np.uint64)]))
            self.up, self.down = grow(_U(self.base)), grow(_U(self.inv))
        return self.up, self.down


_SEEDS = [(0x1B873593A5A5, _Powers(0x9E3779B97F4A7C15 | 1)), (0x5851F42D4C957F, _Powers(0xD1342543DE82EF95 | 1))]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 document offsets; null is an empty text."""
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]


def pieces(batches, text: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of text each, or one document."""
    for b in batches:
        off = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), np.int64))])
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
    release()


def release() -> None:
    """Gives freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n+1 offsets of the documents' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~sep[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; `which` picks one of two independent functions."""
    seed, powers = _SEEDS[which]
    out, lookup, i = np.empty(len(starts), np.uint64), _table(seed), 0
    while i < len(starts):  # spans are in order and don't overlap
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers.upto(hi - lo + 1)
        sums = np.concatenate([[_U(0)], np.cumsum(lookup[data[lo:hi]] * up[: hi - lo], dtype=np.uint64)])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def ngrams(words: np.ndarray, off: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, each one's first word, and n+1 offsets of the documents' n-grams."""
    count = np.maximum(np.diff(off) - n + 1, 0)
    to = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(to[-1]) + np.repeat(off[:-1] - to[:-1], count)
    h = np.full(max(len(words) - n + 1, 0), _U(seed * 2 + 1))
    for k in range(n):
        h = h * _U(0xC2B2AE3D27D4EB4F) + words[k : k + len(h)]
    return mix(h[at]) if len(at) else np.zeros(0, np.uint64), at, to


def owners(off: np.ndarray) -> np.ndarray:
    """The document of each element, from its offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def blobs(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """One binary value per document, holding its elements' bytes."""
    body = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * body.itemsize).astype(np.int32)), pa.py_buffer(body.tobytes())])


def spread(texts: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """A text column in slices of at most `most` bytes, or one document."""
    for b in pieces([pa.RecordBatch.from_arrays([texts], names=["text"])], most=most):
        yield b.column(0)
