"""A bounded memo of token ids by 64-bit hashes, in flat arrays."""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
ABSENT = -1


class Memo:
    """hash → a run of token ids, for whole arrays of hashes at once.

    An open-addressing table of ``2**bits`` places; it is emptied when half full or when the ids take more than
    ``max_ids``, which costs time and changes nothing. At the default size it takes at most about 40 MB.
    """

    def __init__(self, bits: int = 20, max_ids: int = 4_000_000):
        self.bits, self.max_ids = bits, max_ids
        self.mask = _U64((1 << bits) - 1)
        self.empty()

    def empty(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros(size, _U64)
        self.entry = np.full(size, ABSENT, np.int32)
        self.count, self.used = 0, 0
        self.bounds = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)

    def full(self, more: int = 0) -> bool:
        return self.count + more > (1 << self.bits) // 2 or self.used > self.max_ids

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Entry numbers, ABSENT for unknown hashes."""
        place = (codes & self.mask).astype(np.int64)
        got = self.entry[place]
        seek = np.flatnonzero((got != ABSENT) & (self.keys[place] != codes))
        while len(seek):
            place[seek] = (place[seek] + 1) & int(self.mask)
            got[seek] = self.entry[place[seek]]
            seek = seek[(got[seek] != ABSENT) & (self.keys[place[seek]] != codes[seek])]
        return got

    def add(self, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New hashes (distinct and absent), the number of ids of each, and all ids in order."""
        n, base = len(codes), self.count
        while base + n + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.bounds[base + 1 : base + n + 1] = self.used + np.cumsum(sizes)
        self.ids[self.used : self.used + len(ids)] = ids
        self.count, self.used = base + n, self.used + len(ids)
        place = (codes & self.mask).astype(np.int64)
        left = np.arange(n)
        while len(left):
            free = left[self.entry[place[left]] == ABSENT]
            self.entry[place[free]] = free + base
            left = left[self.entry[place[left]] != left + base]  # taken before, or by another of these
            place[left] = (place[left] + 1) & int(self.mask)
        self.keys[place] = codes

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after the other, and where each begins (one more at the end)."""
        low = self.bounds[entries]
        size = self.bounds[entries + 1] - low
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(total[-1]) + np.repeat(low - total[:-1], size)], total
