"""Words of many texts as NumPy arrays: the shared kernel of the Arrow tasks.

A text is a run of UTF-8 bytes. White space is the six ASCII characters 0x20 and 0x09-0x0D, so a
byte-wise scan finds the same words as one over code points. All functions are vectorised over a
slice of documents that is bounded in bytes, never over a whole partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64)
_GROUP = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds), for fingerprints that are well spread."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of about `most` bytes; null texts are empty."""
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.binary()).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of `letters` (of 256 bytes), and the number of runs of each text."""
    inside = letters[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def _power(kind: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < n:
        size = max(n, _GROUP + 4096)
        table = np.empty(size, dtype=np.uint64)
        table[0] = 1
        done = 1
        while done < size:  # doubling: powers[done:2*done] = powers[:done] * base**done
            k = min(done, size - done)
            table[done : done + k] = table[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
        _powers[kind] = table
    return table


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words: a tabulated polynomial over the bytes, then a finaliser.

    Two different words agree with a chance of about 2**-60; a billion different words then hold
    about one such pair.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + _GROUP, side="right")))
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        n = int(b[-1])
        values = np.empty(n + 1, dtype=np.uint64)
        np.multiply(_CODES[data[base : base + n]], _power("up", _BASE, n)[:n], out=values[:n])
        values[n] = 0
        bounds = np.empty(2 * len(a), dtype=np.int64)
        bounds[::2], bounds[1::2] = a, b
        h = np.add.reduceat(values, bounds)[::2]
        h *= _power("down", _BASE_INVERSE, n)[a]
        out[lo:hi] = h + (b - a).astype(np.uint64)
        lo = hi
    return mix(out)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of `n` words of one sequence of word fingerprints."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def squeezed(text: bytes) -> bytes:
    """Each run of white space as one space."""
    text = text.translate(SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text
