"""Hashes of words and word shingles for whole Arrow batches, with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lowered. UTF-8 keeps
these bytes to themselves, so the work is done on the batch's byte buffer, a slice of
documents at a time; nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at a time (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudorandom 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1_000_003)) * U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = stream(1, 256)
_LETTER[65:91] = _LETTER[97:123]
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, base, U)]), dtype=U)
        if size <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after the other, and each row's bounds in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES each."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


#: Bytes between words: white space, or every ASCII character that is neither letter nor digit.
BLANK = _SPACE
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _words(part: np.ndarray, edges: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of these bytes begin and end; none crosses an edge."""
    solid = ~gaps[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[edges] = True
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    stops[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def line_firsts(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = BLANK) -> np.ndarray:
    """For each word of word_hashes(): whether it is the first of its row, or of a line of it."""
    first = int(bounds[0])
    part = data[first : int(bounds[-1])]
    if not len(part):
        return np.zeros(0, bool)
    start, _ = _words(part, bounds - first, gaps)
    breaks = np.cumsum((part == 0x0A) | (part == 0x0D))[start]
    row = np.searchsorted(bounds - first, start, "right")
    return np.concatenate([np.ones(min(len(start), 1), bool), (np.diff(breaks) > 0) | (np.diff(row) > 0)])


def word_hashes(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows with these bounds: the hash of each word in order, and each row's bounds in that list."""
    first, rows = int(bounds[0]), len(bounds) - 1
    part = data[first : int(bounds[-1])]
    if not len(part):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    start, end = _words(part, bounds - first, gaps)
    total = np.zeros(len(part) + 1, U)
    np.cumsum(_LETTER[part] * _power(_STEP, len(part)), out=total[1:])
    words = mix((total[end] - total[start]) * _power(_BACK, len(part))[start] + (end - start).astype(U))
    return words, np.searchsorted(start, bounds - first, "left")


_PLACE = stream(2, 64) | U(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles in order of place (repeats kept), and bounds; a row of fewer words has its whole sequence as one."""
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(out_bounds[-1]), U)
    if len(words) >= size:
        whole = len(words) - size + 1
        h = np.zeros(whole, U)
        for k in range(size):
            h += words[k : whole + k] * _PLACE[k]
        row = np.repeat(np.arange(len(counts)), counts)
        inside = row[:whole] == row[size - 1 :]
        long_rows = np.repeat(counts >= size, n)
        out[long_rows] = mix(h[inside])
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[bounds[r] : bounds[r + 1]]
        out[out_bounds[r]] = mix((w * _PLACE[: len(w)]).sum(dtype=U, keepdims=True) + U(len(w)))[0]
    return out, out_bounds


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin fingerprints of every window of so many words of one text, from running sums."""
    if len(words) < size:
        return np.zeros(0, U)
    total = np.concatenate([np.zeros(1, U), np.cumsum(words * _power(_STEP, len(words)), dtype=U)])
    return mix((total[size:] - total[:-size]) * _power(_BACK, len(words))[: len(words) - size + 1])
