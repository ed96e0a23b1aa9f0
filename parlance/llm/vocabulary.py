"""Distinct terms of whole Arrow columns, told apart by their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from parlance.llm import words as W

_COMPARED = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def same(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the pieces of `a` and `b` that begin at the given places hold the same bytes; no piece is empty."""
    out = np.empty(len(length), bool)
    upto = np.cumsum(length)
    i = 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _COMPARED, "right")))
        size = length[i:j]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = a[np.repeat(a_at[i:j], size) + place] == b[np.repeat(b_at[i:j], size) + place]
        out[i:j] = np.logical_and.reduceat(equal, first)
        i = j
    return out


class Terms:
    """All terms of a column: `row` and `kind` of each, and where each kind occurs first.

    Bytes marked in `between` are no part of a term. Terms of one hash are compared with its first term byte by byte.
    """

    def __init__(self, texts: pa.Array, between: np.ndarray):
        data, offsets = W.buffers(texts)
        hashes, starts, ends, bounds = W.words(data, offsets, between)
        self.data = _LOWER[data]
        self.row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        length = ends - starts
        if (length != length[first][kind]).any() or not same(self.data, starts, self.data, starts[first][kind], length).all():
            seen: dict[bytes, int] = {}
            kind = np.array([seen.setdefault(self.data[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends)])
            first = np.unique(kind, return_index=True)[1]
        self.kind, self.hash, self.start, self.length = kind, hashes[first], starts[first], length[first]

    def __len__(self) -> int:
        return len(self.hash)

    def bytes(self, kinds: np.ndarray) -> list[bytes]:
        return [self.data[s:s + n].tobytes() for s, n in zip(self.start[kinds].tolist(), self.length[kinds].tolist())]
