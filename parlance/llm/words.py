"""Words of whole Arrow columns as 64-bit hashes, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z folded to a-z. Texts are read in segments cut
between words, so working memory does not follow the length of a text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 21
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but digits and letters: words without their punctuation.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _values(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.int64)
    if fold:
        codes[65:91] += 32
    return mix(codes.astype(_U) + _U(0x1234567)) | _U(1)


_FOLDED, _PLAIN = _values(True), _values(False)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    up, down = np.empty(n, _U), np.empty(n, _U)
    up[0] = down[0] = 1
    inverse = pow(_BASE, -1, 1 << 64)
    for out, base in ((up, _BASE), (down, inverse)):
        have, step = 1, base
        while have < n:
            more = min(have, n - have)
            out[have:have + more] = out[:more] * _U(step)
            have, step = have + more, step * step % (1 << 64)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _SEGMENT + 2
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash for each data[start:end]; sorted by start, in segments."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
        part = data[low:int(ends[j - 1])]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((_FOLDED if fold else _PLAIN)[part] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, words before each row and after the last) of every word of every row."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, _U), none, none, np.zeros(len(offsets), np.int64)
    blank = np.ones(n + 1, bool)
    np.take(between, data, out=blank[:n])
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.ones(n, bool)
    before[1:] = blank[:n - 1]
    starts = np.flatnonzero(~blank[:n] & (before | fresh[:n]))
    ends = np.flatnonzero(~blank[:n] & (blank[1:] | fresh[1:])) + 1
    return pieces_hash(data, starts, ends, True), starts, ends, np.searchsorted(starts, offsets)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 23):
    """Parts of a batch with about `most` bytes of text each, a longer row by itself."""
    size = np.cumsum(np.diff(buffers(batch.column(column))[1]))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle: `width` words, or the whole of a shorter row that has any."""
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    full = np.arange(n) + width <= bounds[1:][row] if n else np.empty(0, bool)
    at = np.flatnonzero(full)
    out = np.zeros(len(at), _U)
    for k in range(width):
        out = mix(out * _U(_BASE) + hashes[at + k])
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = np.zeros(len(short), _U)
    for x, r in enumerate(short):
        h = np.full(1, counts[r], _U)
        for k in range(bounds[r], bounds[r + 1]):
            h = mix(h * _U(_BASE) + hashes[k])
        extra[x] = h[0]
    return np.concatenate([row[at], short]), np.concatenate([out, extra])


def distinct_by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row, then value, without repeats."""
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
