"""A minimal perfect hash over a fixed list of byte strings, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

from parlance.llm.words import mix

_GAMMA = 2.0


class PerfectHash:
    """Levels of bit arrays: a key takes the first level where no other key shares its slot; ranks of bits number the keys.

    A look-up of a foreign key gives some key's number or -1, so callers compare the 64-bit fingerprint kept for each number.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.fingerprint = np.zeros(len(keys), np.uint64)
        left, done = np.arange(len(keys)), 0
        self.value = np.zeros(len(keys), np.int64)
        while len(left):
            size = max(64, int(len(left) * _GAMMA))
            slot = self._slot(keys[left], len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            rank = done + np.cumsum(alone) - 1
            fits = alone[slot]
            number = rank[slot[fits]]
            self.fingerprint[number] = keys[left[fits]]
            self.value[number] = left[fits]
            self.levels.append((alone, rank))
            done, left = done + int(fits.sum()), left[~fits]
            if len(self.levels) > 60:
                raise ValueError("two keys have one hash")

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the list it was built from, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            slot = self._slot(keys[left], level, len(alone))
            hit = alone[slot]
            number = rank[slot[hit]]
            same = self.fingerprint[number] == keys[left[hit]]
            out[left[hit][same]] = self.value[number[same]]
            left = left[~hit]
        return out
